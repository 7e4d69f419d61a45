"""Where completions come from.  extract(chunks) gives (chunk_id, completion, token_logprobs).

``table`` replays stored completions, ``rules`` is a deterministic pattern extractor (a
different algorithm from a language model), ``http`` asks a completions endpoint.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences
from ..operators.segment import prompt
from ..ontology import triple_json_schema

SCHEMA = "chunk_id long, completion string, token_logprobs array<double>"

#: Phrases of the rule extractor and the predicates that they stand for.
PHRASES = {
    "is part of": "part_of", "is located in": "located_in", "is a": "is_a", "regulates": "regulates", "develops": "develops",
    "contains": "contains", "manages": "manages", "requires": "requires", "produces": "produces", "depends on": "depends_on",
}


def from_table(chunks: DataFrame, completions: DataFrame) -> DataFrame:
    return completions.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", "completion", "token_logprobs")


def by_rules(chunks: DataFrame) -> DataFrame:
    """Sentences "X <phrase> Y." become triples of concepts; JVM-side."""
    pattern = r"^(.{2,60}?) (" + "|".join(PHRASES) + r") (.{2,60}?)[.!?]?$"
    hit = F.filter(sentences(F.col("text")), lambda s: s.rlike(pattern))
    name = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    kind = F.lit("CONCEPT")
    item = F.transform(hit, lambda s: F.struct(F.regexp_extract(s, pattern, 1).alias("subject"), kind.alias("subject_type"), F.element_at(name, F.regexp_extract(s, pattern, 2)).alias("predicate"), F.regexp_extract(s, pattern, 3).alias("target"), kind.alias("target_type")))
    return chunks.select("chunk_id", F.to_json(F.struct(item.alias("triples"))).alias("completion"), F.array().cast("array<double>").alias("token_logprobs"))


def post(url: str, payload: dict, timeout: float = 120.0) -> dict:
    import urllib.request

    req = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(req, timeout=timeout) as r:
        return json.loads(r.read())


def by_http(chunks: DataFrame, url: str, model: str, batch: int = 8, max_tokens: int = 768, temperature: float = 0.1, top_p: float = 0.9, schema: bool = True, send: Callable[[str, dict], dict] = post) -> DataFrame:
    """Batches of prompts to an OpenAI-style completions endpoint; choices are put in order by index.

    A failed batch raises, so the task is tried again on another executor.
    """
    asked = chunks.select("chunk_id", prompt(F.col("text")).alias("prompt"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for at in range(0, len(p), batch):
                rows = p.iloc[at : at + batch]
                payload = {"model": model, "prompt": rows.prompt.tolist(), "max_tokens": max_tokens, "temperature": temperature, "top_p": top_p, "logprobs": 1}
                if schema:
                    payload["guided_json"] = triple_json_schema()
                got = sorted(send(f"{url.rstrip('/')}/v1/completions", payload)["choices"], key=lambda c: c["index"])
                logs = [[x for x in (c.get("logprobs") or {}).get("token_logprobs") or [] if x is not None] for c in got]
                yield pd.DataFrame({"chunk_id": rows.chunk_id.tolist(), "completion": [c["text"] for c in got], "token_logprobs": logs})

    return asked.mapInPandas(run, SCHEMA)
