"""Tool-call linking for chat data (DataFrame functions only).

Calls and results are joined by conversation and identifier, calls are put in an order in
which every call comes after the calls that it depends on, arguments are validated against
schemas, and each linked call is serialised as canonical JSON (keys in code point order, no
white space, numbers and booleans bare).

Rows are per call, never per conversation, so a conversation of any length is spread over
all tasks; orders are sort keys instead of ranks. Chains of dependencies are followed by
doubling, so the rounds are logarithmic in the longest chain, and no round has more rows than
there are dependencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: JSON types -> what a textual argument must look like.
TYPES = {
    "integer": r"^-?(0|[1-9][0-9]*)$",
    "number": r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$",
    "boolean": r"^(true|false)$",
}
KEY = ["conv_id", "call_id"]


def quoted(value: Column) -> Column:
    """A string as a JSON string (null: null)."""
    text = F.to_json(F.array(value))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def _bare(kind: Column, value: Column) -> Column:
    fits = F.lit(False)
    for name, pattern in TYPES.items():
        fits = fits | ((kind == name) & value.rlike(pattern))
    return F.when(fits, value).otherwise(quoted(value))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id) of either side: the first call, the first result, and how many there are.

    calls: conv_id, call_id, pos, name, arguments map<string,string>, depends_on array<string>;
    results: conv_id, call_id, pos, content. "First" is by pos, then by the other columns, so
    repeated identifiers never multiply. Rows without an identifier are left out.
    """
    call = F.struct("pos", "name", F.sort_array(F.map_entries("arguments")).alias("arguments"),
                    F.sort_array(F.array_distinct("depends_on")).alias("depends_on"))
    one = calls.dropna(subset=KEY).groupBy(*KEY).agg(F.min(call).alias("call"), F.count("*").alias("n_calls"))
    two = results.dropna(subset=KEY).groupBy(*KEY).agg(F.min(F.struct("pos", "content")).alias("result"), F.count("*").alias("n_results"))
    # both sides have one row for an identifier: a hash join, without hot keys
    both = one.join(two.hint("shuffle_hash"), KEY, "full")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return both.select(*KEY, "call", "result", zero("n_calls"), zero("n_results"))


def ordered(linked: DataFrame) -> DataFrame:
    """(conv_id, call_id, release, step, cyclic, unresolved) for each call of ``linked``.

    By (release, step, call_id) every call follows the calls it depends on: release is the
    latest position among a call and all it needs. A call that needs one at its own position or
    later has as its step the length of its longest chain of dependencies; others have 0.
    ``cyclic`` calls are on or behind a cycle (a chain as long as the conversation has calls)
    and stay unordered, at their own position. ``unresolved`` counts dependencies on calls that
    the conversation does not have. A null position counts as -1.

    Conversations in which calls depend on earlier ones only are in order as they are. In the
    others a call is settled when all it needs is, and in the same round each dependency on a
    call that waits for one other only is moved on to that one. A round that settles no call
    leaves those on or behind cycles. A graph that branches again and again along its whole
    depth, where no call waits for one other only, takes a round for each level.
    """
    nodes = linked.where("call is not null").select(*KEY, F.coalesce("call.pos", F.lit(-1)).alias("pos"), "call.depends_on")
    there = nodes.select("conv_id", F.col("call_id").alias("needs"), F.col("pos").alias("at"))
    edges = nodes.select(*KEY, "pos", F.explode("depends_on").alias("needs")).where("needs is not null")
    edges = stored(edges.join(there, ["conv_id", "needs"], "left"), "edges")
    missing = edges.where("at is null").groupBy(*KEY).agg(F.count("*").alias("unresolved"))
    ahead = edges.where("at >= pos").select("conv_id").distinct()
    # waits: chain and latest of a call are at least steps more than those of the call it needs, and at
    waits = stored(edges.where("at is not null").join(ahead, "conv_id", "left_semi").select(
        *KEY, "needs", F.lit(1).cast("long").alias("steps"), "at"), "waits")
    waiting = waits.select(*KEY, F.lit(True).alias("waiting")).distinct()
    state = stored(nodes.select(*KEY).join(ahead, "conv_id", "left_semi").join(waiting, KEY, "left").select(
        *KEY, F.lit(0).cast("long").alias("chain"), F.lit(None).cast("long").alias("latest"), F.col("waiting").isNull().alias("settled")), "state")
    settled = 1
    while settled:
        needed = state.select("conv_id", F.col("call_id").alias("needs"), F.col("chain").alias("c"), F.col("latest").alias("l"), F.col("settled").alias("over"))
        one = F.when(F.count("*") == 1, F.min(F.struct("needs", "steps", "at")))
        onward = waits.groupBy(*KEY).agg(one.alias("on")).where("on is not null").select("conv_id", F.col("call_id").alias("needs"), "on")
        moved = waits.join(needed, ["conv_id", "needs"]).join(onward, ["conv_id", "needs"], "left")
        goes = F.col("on").isNotNull() & (F.col("on.needs") != F.col("needs"))
        reached = F.col("over") | goes
        moved = stored(moved.select(
            *KEY, F.when(reached, F.col("steps") + F.col("c")).alias("chain"), F.when(reached, F.greatest("at", "l")).alias("latest"),
            F.when(~F.col("over"), F.when(goes, F.col("on.needs")).otherwise(F.col("needs"))).alias("needs"),
            # along a cycle steps would double without end
            F.when(goes, F.least(F.col("steps") + F.col("on.steps"), F.lit(1 << 40))).otherwise(F.col("steps")).alias("steps"),
            F.when(goes, F.greatest("at", "on.at")).otherwise(F.col("at")).alias("at")), "moved")
        waits = stored(moved.where("needs is not null").groupBy(*KEY, "needs").agg(F.max("steps").alias("steps"), F.max("at").alias("at")), "waits")
        more = moved.groupBy(*KEY).agg(F.max("chain").alias("c"), F.max("latest").alias("l"), F.count("needs").alias("left"))
        new = state.join(more, KEY, "left").select(
            *KEY, F.greatest("chain", "c").alias("chain"), F.greatest("latest", "l").alias("latest"), F.col("settled").alias("before"),
            (F.col("settled") | (F.coalesce("left", F.lit(0)) == 0)).alias("settled"))
        new = stored(new, "state")
        settled, state = new.where("settled and not before").limit(1).count(), new.drop("before")
    state = state.withColumn("cyclic", ~F.col("settled"))
    cyclic = F.coalesce("cyclic", F.lit(False))
    late = ~cyclic & F.coalesce(F.col("latest") >= F.col("pos"), F.lit(False))
    return nodes.join(state, KEY, "left").join(missing, KEY, "left").select(
        *KEY, F.when(late, F.col("latest")).otherwise(F.col("pos")).alias("release"), F.when(late, F.col("chain")).otherwise(0).alias("step"),
        cyclic.alias("cyclic"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))


def validated(linked: DataFrame, schemas: DataFrame) -> DataFrame:
    """``linked`` with ``invalid`` (sorted array of "argument: fault") and ``arguments`` as canonical JSON.

    schemas: name, parameter, type (integer, number, boolean or string), required. Faults
    are ``missing``, ``unknown`` (also every argument of a name without a schema, and
    ``name: unknown``) and ``type``.
    """
    known = schemas.groupBy("name").agg(F.map_from_entries(F.collect_set(F.struct(
        F.col("parameter"), F.struct("type", "required")))).alias("parameters"))
    rows = linked.withColumn("name", F.col("call.name")).join(known, "name", "left")
    none = F.create_map().cast("map<string,struct<type:string,required:boolean>>")
    rows = rows.withColumn("parameters", F.when(F.col("call").isNotNull(), F.coalesce("parameters", none)))
    given = F.coalesce(F.col("call.arguments"), F.array().cast("array<struct<key:string,value:string>>"))
    kind = lambda key: F.element_at("parameters", key)["type"]

    def fault(entry: Column) -> Column:
        wrong = F.lit(False)
        for name, pattern in TYPES.items():
            wrong = wrong | ((kind(entry["key"]) == name) & ~F.coalesce(entry["value"].rlike(pattern), F.lit(False)))
        return F.when(kind(entry["key"]).isNull(), F.concat(entry["key"], F.lit(": unknown"))).when(
            wrong, F.concat(entry["key"], F.lit(": type")))

    faults = F.filter(F.transform(given, fault), lambda x: x.isNotNull())
    absent = F.transform(
        F.filter(F.map_entries("parameters"), lambda p: p["value"]["required"] & ~F.array_contains(
            F.transform(given, lambda e: e["key"]), p["key"])),
        lambda p: F.concat(p["key"], F.lit(": missing")))
    nameless = F.when(F.col("call").isNotNull() & (F.size("parameters") == 0), F.array(F.lit("name: unknown"))).otherwise(
        F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    json = F.concat(F.lit("{"), F.array_join(F.transform(given, lambda e: F.concat(
        quoted(e["key"]), F.lit(":"), _bare(kind(e["key"]), e["value"]))), ","), F.lit("}"))
    return rows.withColumn("invalid", F.sort_array(F.concat(faults, F.coalesce(absent, empty), nameless))).withColumn(
        "arguments", F.when(F.col("call").isNotNull(), json)).drop("parameters", "name")


def linked_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per (conv_id, call_id): status, order keys, faults and canonical JSON.

    status: ``linked``, ``unanswered`` (a call without a result), ``orphan`` (a result without
    a call) or ``cyclic``. Order keys of orphans are their own positions. Empty tables give
    an empty result; null names, arguments, positions and contents are serialised as null, texts
    of any length whole; repeated rows count in n_calls and n_results; of several calls or
    results of an identifier the first by position, then by the other columns, is taken; other
    columns are ignored.
    """
    both = stored(link(calls, results), "linked")
    rows = validated(both, schemas).join(ordered(both), KEY, "left")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("cyclic"), "cyclic").when(F.col("result").isNull(), "unanswered").otherwise("linked")
    content = F.when(F.col("result").isNull(), F.lit("null")).otherwise(quoted(F.col("result.content")))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce("arguments", F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), quoted(F.col("call.name")), F.lit(',"result":'), content, F.lit("}"))
    return rows.select(
        *KEY, "n_calls", "n_results", status.alias("status"), F.array_join("invalid", "; ").alias("invalid"),
        F.coalesce("release", "result.pos", F.lit(-1)).alias("release"), F.coalesce("step", F.lit(0)).alias("step"),
        F.coalesce("unresolved", F.lit(0)).alias("unresolved"), json.alias("json"))


def exchanges(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that chat turns (conv_id, turn, role, text) stand for.

    A user turn calls ``reply`` (``c`` and its turn) with its text, length and turn. An assistant
    turn is the result of the call one turn before. What a call depends on goes by conv_id
    modulo 5: 1 the call two turns later, 2 those two turns before and later, else the one two
    turns before. By conv_id modulo 7 arguments have faults: 3 a length that is no number, 4 no
    turn, 5 one argument too many. Null conv_ids and turns make no calls.
    """
    turn, text, conv_id = F.col("turn").cast("long"), F.col("text").cast("string"), F.col("conv_id").cast("long")
    ident = lambda back: F.concat(F.lit("c"), (turn - back).cast("string"))
    base = [conv_id.alias("conv_id"), turn.alias("pos")]
    case = F.pmod(conv_id, F.lit(7))
    size = F.length(text).cast("string")
    arguments = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("text").alias("key"), text.alias("value")),
        F.when(case != 4, F.struct(F.lit("turn").alias("key"), turn.cast("string").alias("value"))),
        F.struct(F.lit("n_chars").alias("key"), F.when(case == 3, F.concat(size, F.lit(" characters"))).otherwise(size).alias("value")),
        F.when(case == 5, F.struct(F.lit("tone").alias("key"), F.lit("plain").alias("value"))))))
    kind = F.pmod(conv_id, F.lit(5))
    earlier = F.when((turn >= 2) & (kind != 1), ident(2))
    later = F.when((kind == 1) | (kind == 2), ident(-2))
    calls = turns.where("role = 'user'").select(
        *base, ident(0).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"),
        F.array_compact(F.array(earlier, later)).alias("depends_on"))
    results = turns.where("role = 'assistant'").select(*base, ident(1).alias("call_id"), text.alias("content"))
    return calls, results
