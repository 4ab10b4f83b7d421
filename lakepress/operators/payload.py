"""Requests in three dialects: extraction of text blocks, write-back, and the decision on a whole payload.

Requests: payload_id, api, payload (JSON text). Extraction goes through VARIANT, as the
same field holds a string in one request and an array in the next.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lakepress.functions import handler, lanes
from lakepress.functions.handler import APIS
from lakepress.functions.rewrite import rewrite
from lakepress.functions.text import is_shell_tool, savings_percent
from lakepress.plans.config import Config


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _array(v: Column) -> Column:
    return F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _string(v: Column, name: str) -> Column:
    """A field if it is a string, else null."""
    inner = _field(v, name)
    return F.when(_is(inner, "STRING"), _text(v, f"$.{name}"))


def _with_messages(requests: DataFrame) -> DataFrame:
    """Requests of a known shape with their array of messages `ms`, roles, and the last user and assistant message (-1: none)."""
    parsed = requests.select("payload_id", "api", F.try_parse_json("payload").alias("v")).where(F.col("api").isin(*APIS))
    listed = F.when(F.col("api") == "openai-responses", _field(F.col("v"), "input")).otherwise(_field(F.col("v"), "messages"))
    rows = parsed.withColumn("ms", _array(listed)).where("ms is not null").drop("v")
    responses = F.col("api") == "openai-responses"
    role = lambda m: F.when(~responses | F.coalesce(_string(m, "type") == "message", F.lit(False)), _string(m, "role"))
    rows = rows.withColumn("roles", F.transform("ms", lambda m, i: F.struct(i.alias("i"), role(m).alias("role"))))
    last = lambda who: F.coalesce(F.array_max(F.transform(F.filter("roles", lambda r: r["role"] == who), lambda r: r["i"])), F.lit(-1))
    return rows.withColumns({"last_user": last("user"), "last_assistant": last("assistant")})


_CALL = "array<struct<call_id:string,name:string>>"


def _calls(m: Column) -> Column:
    """(call_id, name) of the tool calls in a message, in order."""
    api = F.col("api")
    none = F.array().cast(_CALL)
    use = F.transform(F.filter(_array(_field(m, "content")), lambda p: _string(p, "type") == "tool_use"), lambda p: F.struct(_string(p, "id").alias("call_id"), _string(p, "name").alias("name")))
    calls = F.transform(_array(_field(m, "tool_calls")), lambda p: F.struct(_string(p, "id").alias("call_id"), F.when(_is(F.try_variant_get(p, "$.function.name", "variant"), "STRING"), _text(p, "$.function.name")).alias("name")))
    item = F.when(_string(m, "type") == "function_call", F.array(F.struct(_string(m, "call_id").alias("call_id"), _string(m, "name").alias("name"))))
    return F.coalesce(F.when(api == APIS[0], use).when(api == APIS[1], calls).otherwise(item), none)


def _part(part: Column | int, kind: str, content: Column | str, text: Column, call: Column | None = None) -> Column:
    return F.struct(
        (F.lit(part) if isinstance(part, int) else part).cast("int").alias("part"),
        F.lit(kind).alias("kind"),
        (F.lit(content) if isinstance(content, str) else content).alias("content_kind"),
        text.alias("text"),
        (call if call is not None else F.lit(None).cast("string")).alias("call_id"),
    )


_PARTS = "array<struct<part:int,kind:string,content_kind:string,text:string,call_id:string>>"


def _parts(m: Column, role: Column, parts: Column) -> Column:
    """The text parts of a message, by dialect; parts: its content as an array, or null."""
    api = F.col("api")
    content = _field(m, "content")
    user, none = role == "user", F.array().cast(_PARTS)
    whole = F.when(user & (api != APIS[2]) & _is(content, "STRING"), F.array(_part(0, "user", "string", _text(m, "$.content"))).cast(_PARTS))

    def inside(p: Column, i: Column) -> Column:
        inner = _field(p, "content")
        listed = _array(inner)
        mixed = F.exists(listed, lambda x: _is(x, "OBJECT") & ~F.coalesce(_string(x, "type") == "text", F.lit(False)))
        joined = F.array_join(F.filter(F.transform(listed, lambda x: _string(x, "text")), lambda t: t.isNotNull() & (t != "")), "\n")
        result = F.when(listed.isNull(), F.when(_is(inner, "STRING"), _text(p, "$.content"))).when(~mixed, joined)
        kind = _string(p, "type")
        wanted = F.when(api == APIS[2], F.lit("input_text")).otherwise(F.lit("text"))
        as_tool = _part(i, "tool", F.when(listed.isNotNull(), "array").otherwise("string"), result, _string(p, "tool_use_id"))
        as_user = _part(i, "user", "array", _string(p, "text"))
        return F.when((api == APIS[0]) & (kind == "tool_result"), as_tool).when(user & (kind == wanted), as_user)

    listed = F.when(role.isin("user", "assistant"), F.transform(parts, inside)).cast(_PARTS)
    tool = F.when((api == APIS[1]) & (role == "tool") & _is(content, "STRING"), F.array(_part(0, "tool", "string", _text(m, "$.content"), _string(m, "tool_call_id"))).cast(_PARTS))
    output = F.when((api == APIS[2]) & (_string(m, "type") == "function_call_output") & _is(_field(m, "output"), "STRING"), F.array(_part(0, "tool", "string", _text(m, "$.output"), _string(m, "call_id"))).cast(_PARTS))
    return F.filter(F.coalesce(whole, listed, tool, output, none), lambda x: x["text"].isNotNull() & (x["text"] != ""))


def blocks(requests: DataFrame) -> DataFrame:
    """Text blocks of all requests, with is_shell_tool; requests of other shapes have none.

    Each request is parsed once and stays in its row until its blocks are rows; nothing is exchanged.
    """
    rows = _with_messages(requests).withColumn("calls", F.filter(F.flatten(F.transform("ms", _calls)), lambda c: c["call_id"].isNotNull() & c["name"].isNotNull()))
    rows = rows.select("payload_id", "api", "roles", "calls", "last_user", "last_assistant", F.posexplode("ms").alias("message", "m"))
    rows = rows.withColumn("role", F.get("roles", F.col("message"))["role"]).withColumn("own", _array(_field(F.col("m"), "content")))
    rows = rows.withColumn("found", _parts(F.col("m"), F.col("role"), F.col("own")))
    rows = rows.select("payload_id", "api", "message", "calls", "last_user", "last_assistant", F.explode("found").alias("b")).select("*", "b.*")
    name = F.get(F.reverse(F.filter("calls", lambda c: c["call_id"] == F.col("call_id"))), F.lit(0))["name"]
    newest = (F.col("message") == F.col("last_user")) & ((F.col("kind") == "user") | (F.col("api") == APIS[0]))
    return rows.select(
        "payload_id", "api", "message", "part", "kind", "content_kind", "text", newest.alias("is_newest_user"), (F.col("message") > F.col("last_assistant")).alias("is_current_turn"), ((F.col("kind") == "tool") & is_shell_tool(name)).alias("is_shell_tool")
    )


@F.pandas_udf(StringType())
def rewritten(api: pd.Series, payload: pd.Series, changes: pd.Series) -> pd.Series:
    """The request with new texts at (message, part); all else as it was, in compact JSON."""
    return pd.Series([None if p is None else rewrite(a, p, [(c["message"], c["part"], c["text"]) for c in ([] if x is None else x)]) for a, p, x in zip(api, payload, changes)], dtype=object)


def write_back(requests: DataFrame, changed: DataFrame) -> DataFrame:
    """Requests with the texts of `changed` (payload_id, message, part, text) in their places: adds new_payload.

    Ids tell requests apart here, so they must not repeat; null is an id like others.
    """
    lists = changed.groupBy(F.col("payload_id").alias("__p")).agg(F.sort_array(F.collect_list(F.struct("message", "part", "text"))).alias("changes"))  # a request's own blocks
    joined = requests.join(lists, F.col("payload_id").eqNullSafe(F.col("__p")), "left")
    return joined.withColumn("new_payload", rewritten("api", "payload", "changes")).drop("changes", "__p")


_STEP = "struct<engine:string,savings_percent:double,rejected:boolean>"
_BLOCK = "struct<kind:string,message:int,part:int,is_shell_tool:boolean,is_newest_user:boolean,is_current_turn:boolean,skipped:string,input:string,output:string>"
_DECIDED = (
    f"struct<fallback_reason:string,original_tokens:bigint,compressed_tokens:bigint,payload:string,steps:array<{_STEP}>,blocks:array<{_BLOCK}>,memo_hits:bigint,memo_misses:bigint>"
)
_memos: dict[str, handler.Memo] = {}


def decide(requests: DataFrame, config: Config, count: Callable[[str], int] = lanes.tokens) -> DataFrame:
    """The whole handler, one pass over each request where it lies: payload_id, api, strategy, accepted, fallback_reason, tokens before and
    after, savings, payload (untouched unless accepted), steps, blocks with the reason why one was skipped, memo counts.

    Requests keep to themselves whatever their ids. `count` is the number of tokens of a text. Blocks hold
    texts before and after only with config.debug. The worker keeps what it decided on equal texts, within bounds.
    """
    own = repr(config)

    def told(b: handler.Block) -> tuple:
        texts = (b.text, b.output) if config.debug else (None, None)
        return (b.kind, b.message, b.part, b.shell, b.newest, b.current, b.skipped, *texts)

    def run(api: pd.Series, text: pd.Series) -> pd.DataFrame:
        if own not in _memos:
            _memos.clear()
        memo = _memos.setdefault(own, handler.Memo())
        rows = []
        for a, t in zip(api, text):
            hits, misses = memo.hits, memo.misses
            d = handler.handle(a, t, config, memo, count)
            rows.append((d.reason, d.before, d.after, d.payload, d.steps, [told(b) for b in d.blocks], memo.hits - hits, memo.misses - misses))
        return pd.DataFrame(rows, columns=["fallback_reason", "original_tokens", "compressed_tokens", "payload", "steps", "blocks", "memo_hits", "memo_misses"])

    if not config.enabled:
        requests = requests.limit(0)
    each = F.pandas_udf(run, _DECIDED).asNondeterministic()  # so that a filter on its result does not run it twice
    done = requests.select("payload_id", "api", each("api", "payload").alias("d")).select("payload_id", "api", "d.*")
    return done.select(
        "payload_id",
        "api",
        F.lit(config.strategy).alias("strategy"),
        F.col("fallback_reason").isNull().alias("accepted"),
        "fallback_reason",
        "original_tokens",
        "compressed_tokens",
        savings_percent(F.col("original_tokens"), F.col("compressed_tokens")).alias("savings_percent"),
        "payload",
        "steps",
        "blocks",
        "memo_hits",
        "memo_misses",
    )
