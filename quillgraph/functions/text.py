"""Column expressions over text: sentences, token counts, labels, ids, similarity, shape."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0x7FFF_FFFF_FFFF_FFFF


def strip(c: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """array<string>: split after . ! or ? and white space; empty parts dropped."""
    return F.filter(F.split(text, r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def word_weight(sentence: Column) -> Column:
    """Estimated tokens: words * 1.3."""
    return F.size(F.filter(F.split(strip(sentence), r"(?U)\s+"), lambda w: w != "")) * F.lit(1.3)


def token_count(sentence: Column) -> Column:
    """Estimated tokens, cut to a whole number."""
    return word_weight(sentence).cast("int")


def canonical_label(c: Column) -> Column:
    """Identity of an entity: stripped, lower case, single spaces, one article less, no outer punctuation."""
    low = F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", " ")
    return F.regexp_replace(F.regexp_replace(low, r"^(the|a|an) ", ""), r"^[ .,;:]+|[ .,;:]+$", "")


def entity_id(label: Column) -> Column:
    """Nonnegative 64-bit id of the canonical label; JVM-side."""
    return F.xxhash64(canonical_label(label)).bitwiseAND(F.lit(_MASK))


def exact_entity_id(label: Column) -> Column:
    """The same with hash seed 0, for byte-identical ids with other tools; Arrow UDF."""
    @F.pandas_udf("long")
    def hashed(s: pd.Series) -> pd.Series:
        import xxhash

        return s.map(lambda v: None if v is None else xxhash.xxh64_intdigest(v, seed=0) & _MASK)

    return hashed(canonical_label(label))


def type_aware_id(label: Column, kind: Column) -> Column:
    """Id that separates senses of one label by type."""
    return F.xxhash64(F.concat(label, F.lit("::"), kind)).bitwiseAND(F.lit(_MASK))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def entity_similarity(a: Column, b: Column) -> Column:
    """0.4 * Jaccard of word sets + 0.6 * (1 - Levenshtein / longer length), lower-cased and stripped."""
    a, b = F.lower(strip(a)), F.lower(strip(b))
    wa, wb = word_set(a), word_set(b)
    union = F.size(F.array_union(wa, wb))
    jaccard = F.when(union > 0, F.size(F.array_intersect(wa, wb)) / union).otherwise(0.0)
    longest = F.greatest(F.length(a), F.length(b))
    near = F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(1.0)
    return 0.4 * jaccard + 0.6 * near


def token_sort_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / total length of the texts with sorted words; case-sensitive; Arrow UDF."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        def lcs(s: str, t: str) -> int:
            # bit-parallel row of the dynamic programme: a zero bit is a matched place
            places: dict[str, int] = {}
            for i, ch in enumerate(s):
                places[ch] = places.get(ch, 0) | 1 << i
            full, v = (1 << len(s)) - 1, (1 << len(s)) - 1
            for ch in t:
                u = v & places.get(ch, 0)
                v = ((v + u) | (v - u)) & full
            return bin(full & ~v).count("1")

        def one(s: str, t: str) -> float:
            s, t = " ".join(sorted(s.split())), " ".join(sorted(t.split()))
            return 100.0 if not s and not t else 200.0 * lcs(s, t) / (len(s) + len(t))

        return pd.Series([one(s or "", t or "") for s, t in zip(x, y, strict=True)])

    return ratio(a, b)


def good_shape(c: Column, max_chars: int = 80, max_words: int = 7) -> Column:
    """A short noun phrase: 2 to max_chars characters, few words, no citation, at most one sentence mark."""
    words = F.filter(F.split(F.regexp_replace(c, r"^_+|_+$", ""), r"(?U)[\s_]+"), lambda w: w != "")
    return (F.length(c) > 1) & (F.length(c) <= max_chars) & (F.size(words) <= max_words) & ~c.rlike(r"\([0-9]{4}\)") & ~c.rlike(r"[.!?;][^.!?;]*[.!?;]")


def predicate_key(c: Column) -> Column:
    return F.replace(strip(F.lower(c)), F.lit(" "), F.lit("_"))
