"""op7: canonical chat records of conversations, with tool calls made by a rule on their ids."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import format_chats
from .common import table

#: Tools that calls may name.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "additionalProperties": False},
    "calculator": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}, "digits": {"enum": [1, 2, 3]}}},
}


def _block(kind: str, body: Column) -> Column:
    return F.concat(F.lit(f"\n<tool_{kind}>"), body, F.lit(f"</tool_{kind}>"))


def with_calls(turns: DataFrame) -> DataFrame:
    """Every turn with the calls and results that its conversation's and its own number give it.

    The tables hold plain talk, so this rule makes what the operator is for.  With c and t
    the numbers of conversation and turn: an odd turn calls a tool by the id "t"; the next
    turn brings the result.  An argument refers to the call two turns back (c + t divisible by
    3) or ahead (c mod 7 is 1), which are cycles where both hold.  By c there are also arguments
    against the schema (c mod 5 is 0), unknown tools (c + t mod 8 is 7), results without a
    call (c mod 9 is 3), repeated results (c mod 13 is 4), calls without a result
    (c mod 6 is 5), repeated ids (c mod 10 is 6) and broken blocks (c + t mod 17 is 0).
    """
    c, t = F.col("conv_id"), F.col("turn")
    of = lambda x, n: F.pmod(x, F.lit(n))
    quoted = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    ref = lambda n: F.concat(F.lit('{"$ref":"'), n.cast("string"), F.lit('"}'))
    own = F.when(of(c, 10) == 6, F.lit(1)).otherwise(t).cast("string")
    words = quoted(F.concat(F.lit("turn "), t.cast("string")))
    value = F.when((of(c + t, 3) == 0) & (t >= 2), ref(t - 2)).when(of(c, 7) == 1, ref(t + 2)).otherwise(words)
    search = F.concat(F.lit('{"query":'), value, F.lit(',"limit":'), F.when(of(c, 5) == 0, F.lit('"many"')).otherwise(t.cast("string")), F.lit("}"))
    compute = F.concat(F.lit('{"expression":'), value, F.lit(',"digits":'), (of(c, 5) + 1).cast("string"), F.lit("}"))
    name = F.when(of(c + t, 8) == 7, "translate").when(of(c + t, 2) == 0, "search").otherwise("calculator")
    args = F.when(name == "search", search).otherwise(compute)
    call = _block("call", F.concat(F.lit('{"arguments":'), args, F.lit(',"id":"'), own, F.lit('","name":"'), name, F.lit('"}')))
    back = F.when(of(c, 10) == 6, F.lit(1)).when(of(c, 9) == 3, t + 1000).otherwise(t - 1).cast("string")
    result = _block("result", F.concat(F.lit('{"content":{"words":'), F.length("text").cast("string"), F.lit('},"id":"'), back, F.lit('"}')))
    none = F.lit("")
    said = (
        F.when(of(t, 2) == 1, call)
        .when((t >= 2) & (of(c, 6) != 5), F.concat(result, F.when(of(c, 13) == 4, result).otherwise(none)))
        .otherwise(none)
    )
    broken = F.when(of(c + t, 17) == 0, _block("call", F.lit("{"))).otherwise(none)
    more = F.concat(F.coalesce(said, none), F.coalesce(broken, none))
    return turns.select("conv_id", "turn", "role", F.concat(F.coalesce("text", none), more).alias("text"))


def op7_chat_format(spark, sf_dir):
    return format_chats(with_calls(table(spark, sf_dir, "conversations")), TOOLS)


QUERIES = {"op7_chat_format": op7_chat_format}
ORACLE: dict[str, str] = {}  # canonical JSON has no SQL form: tests compare with a plain version
