"""Parsing and validation of completions, with one reason for every dropped triple."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import good_shape, predicate_key, strip
from ..ontology import ENTITY_TYPES, FORBIDDEN, PREDICATE_ALIASES, PREDICATES, SUBJECT_TYPES, TRIPLE_KEYS, map_literal


def normalize_predicate(c: Column) -> Column:
    key = predicate_key(c)
    return F.coalesce(F.element_at(map_literal(PREDICATE_ALIASES), key), key)


def parse_completions(completions: DataFrame, text_col: str = "completion", strict: bool = True, lenient: bool = False, max_chars: int = 80, max_words: int = 7) -> DataFrame:
    """One row per triple, or per dropped completion: all input columns but the text, pos,
    the five fields and drop_reason (null: accepted).

    Not JSON: dropped_json_parse_error.  An object is opened by its "triples" (absent: no
    triple and no reason); any other value is taken as the list.  A list that is no list,
    or one item with a missing, non-text or unlisted field, drops the whole completion:
    dropped_schema_invalid.  Then per triple: dropped_missing_field after trimming, and
    under ``strict`` dropped_entity_shape.  ``lenient`` resolves predicate aliases first.
    Null completions count as not JSON.
    """
    keep = [c for c in completions.columns if c != text_col]
    v = completions.select(*keep, F.try_parse_json(F.col(text_col)).alias("v"))
    is_object = F.schema_of_variant("v").startswith("OBJECT<")
    listed = F.when(is_object, F.expr("try_variant_get(v, '$.triples', 'variant')")).otherwise(F.col("v"))
    v = v.select(*keep, "v", is_object.alias("is_object"), listed.alias("l"))
    items = F.expr("CASE WHEN schema_of_variant(l) LIKE 'ARRAY<%' THEN try_variant_get(l, '$', 'array<variant>') END")
    v = v.select(*keep, "v", "is_object", "l", items.alias("items"))

    def field(t: Column, name: str, kind: str = "string") -> Column:
        return F.try_variant_get(t, f"$.{name}", kind)

    def fine(t: Column) -> Column:
        texts = [F.coalesce(F.schema_of_variant(field(t, k, "variant")) == "STRING", F.lit(False)) for k in TRIPLE_KEYS]
        ok = texts[0]
        for x in texts[1:]:
            ok = ok & x
        sized = [F.coalesce((F.length(field(t, k)) >= 1) & (F.length(field(t, k)) <= 200), F.lit(False)) for k in ("subject", "target")]
        predicate = normalize_predicate(field(t, "predicate")) if lenient else field(t, "predicate")
        return ok & sized[0] & sized[1] & F.coalesce(field(t, "subject_type").isin(ENTITY_TYPES) & field(t, "target_type").isin(ENTITY_TYPES) & predicate.isin(PREDICATES), F.lit(False))

    reason = (
        F.when(F.col("v").isNull(), "dropped_json_parse_error")
        .when(F.col("is_object") & F.col("l").isNull(), F.lit(None))
        .when(F.col("items").isNull() | ~F.forall("items", fine), "dropped_schema_invalid")
    )
    v = v.select(*keep, "items", reason.alias("drop_reason"))
    fields = F.transform("items", lambda t: F.struct(*[field(t, k).alias(k) for k in TRIPLE_KEYS]))
    rows = F.when(F.col("drop_reason").isNull(), F.coalesce(fields, F.expr(f"CAST(array() AS ARRAY<STRUCT<{', '.join(f'{k}: STRING' for k in TRIPLE_KEYS)}>>)")))
    whole = F.array(F.struct(*[F.lit(None).cast("string").alias(k) for k in TRIPLE_KEYS]))
    v = v.select(*keep, "drop_reason", F.posexplode(F.coalesce(rows, whole)).alias("pos", "t"))
    out = v.select(
        *keep, "pos", strip(F.col("t.subject")).alias("subject"), "t.subject_type", F.col("t.predicate").alias("predicate"),
        strip(F.col("t.target")).alias("target"), "t.target_type", "drop_reason",
    )
    if lenient:
        out = out.withColumn("predicate", normalize_predicate(F.col("predicate")))
    late = F.when(F.col("drop_reason").isNotNull(), F.col("drop_reason")).when((F.col("subject") == "") | (F.col("target") == ""), "dropped_missing_field")
    if strict:
        late = late.when(~good_shape(F.col("subject"), max_chars, max_words) | ~good_shape(F.col("target"), max_chars, max_words), "dropped_entity_shape")
    return out.withColumn("drop_reason", late)


def conforms(text: Column) -> Column:
    """Every item of the list has exactly the five keys, and listed types and predicate."""
    items = F.from_json(text, "triples array<string>")["triples"]

    def ok(t: Column) -> Column:
        get = lambda k: F.get_json_object(t, f"$.{k}")
        return F.coalesce((F.array_sort(F.json_object_keys(t)) == F.array(*[F.lit(k) for k in sorted(TRIPLE_KEYS)])) & get("subject_type").isin(ENTITY_TYPES) & get("target_type").isin(ENTITY_TYPES) & get("predicate").isin(PREDICATES), F.lit(False))

    return F.coalesce(F.forall(items, ok), F.lit(False))


_NAME = r'(?:"([^"]*)"|\'([^\']*)\'|([^"\'\s]+))'
_TYPED = rf"TRIPLE\s+source:\s*{_NAME}(?:\s+type:\s*{_NAME})?\s+predicate:\s*{_NAME}\s+target:\s*{_NAME}(?:\s+type:\s*{_NAME})?\s+confidence:\s*([0-9]*\.?[0-9]+)"
_PLAIN = rf"TRIPLE\s+source:\s*{_NAME}\s+predicate:\s*{_NAME}\s+target:\s*{_NAME}"


def parse_toon(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """TRIPLE lines: (id, pos, subject, subject_type, predicate, target, target_type, confidence).

    Types default to ENTITY, the confidence is held to [0, 1], rows with an empty field
    are skipped.  Only a text without any full line falls back to lines without types and
    confidence (0.8).  A field ends at the quote that opened it.
    """

    def found(pattern: str, typed: bool) -> Column:
        hits = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))

        def part(line: Column, first: int) -> Column:
            return F.trim(F.concat(*[F.regexp_extract(line, pattern, first + k) for k in range(3)]))

        def row(line: Column) -> Column:
            s, st, p, t, tt = (part(line, 1), part(line, 4), part(line, 7), part(line, 10), part(line, 13)) if typed else (part(line, 1), F.lit(""), part(line, 4), part(line, 7), F.lit(""))
            conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.regexp_extract(line, pattern, 16).cast("double"))) if typed else F.lit(0.8)
            named = lambda c: F.when(c == "", "ENTITY").otherwise(c)
            return F.struct(s.alias("subject"), named(st).alias("subject_type"), p.alias("predicate"), t.alias("target"), named(tt).alias("target_type"), conf.alias("confidence"))

        return F.filter(F.transform(hits, row), lambda r: (r["subject"] != "") & (r["predicate"] != "") & (r["target"] != ""))

    both = df.select(id_col, found(_TYPED, True).alias("a"), found(_PLAIN, False).alias("b"))
    return both.select(id_col, F.posexplode(F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b"))).alias("pos", "t")).select(id_col, "pos", "t.*")


def rule_reason() -> Column:
    """First rule that a triple breaks, or null."""
    st, p, tt = F.col("subject_type"), F.col("predicate"), F.col("target_type")
    forbidden = F.concat_ws("|", st, p, tt).isin(["|".join(f) for f in FORBIDDEN])
    subject_ok = F.lit(True)
    for predicate, kinds in SUBJECT_TYPES.items():
        subject_ok = subject_ok & ((p != predicate) | st.isin(kinds))
    return (
        F.when(~(F.coalesce(st.isin(ENTITY_TYPES), F.lit(False)) & F.coalesce(tt.isin(ENTITY_TYPES), F.lit(False))), "dropped_sitl_type_enum")
        .when(forbidden, "dropped_sitl_combo")
        .when(~subject_ok, "dropped_sitl_subject_type")
        .when((F.length(strip(F.col("subject"))) < 2) | (F.length(strip(F.col("target"))) < 2), "dropped_sitl_too_short")
        .when(F.lower("subject") == F.lower("target"), "dropped_sitl_self_loop")
    )


def rule_filter(triples: DataFrame) -> DataFrame:
    """Adds drop_reason where there is none yet."""
    own = rule_reason()
    return triples.withColumn("drop_reason", F.coalesce("drop_reason", own) if "drop_reason" in triples.columns else own)


def accepted(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("drop_reason").isNull()).drop("drop_reason")


def drop_counts(triples: DataFrame) -> DataFrame:
    return triples.where(F.col("drop_reason").isNotNull()).groupBy("drop_reason").agg(F.count("*").alias("n"))


def logprob_confidence(logprobs: Column, scale: float = 8.0, default: float = 0.75) -> Column:
    """min(1, exp(scale * mean of the non-null log-probabilities)), or the default when there is none."""
    lp = F.filter(logprobs, lambda x: x.isNotNull())
    mean = F.aggregate(lp, F.lit(0.0), lambda a, x: a + x) / F.size(lp)
    return F.when(F.size(lp) > 0, F.least(F.lit(1.0), F.exp(mean * scale))).otherwise(default)
