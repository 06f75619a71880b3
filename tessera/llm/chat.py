r"""Chat formatting into budgeted windows, in DataFrame functions only.

A conversation is cut into windows. Prefix sums of its turns' tokens choose turn-
aligned spans of new turns. What the budget leaves beside the system turn and the history is a
span's room. A turn of more than half the room is a span of its own; between such turns, a
turn belongs to the span in whose stretch its first token falls, and the stretch is the room less the longest
of the other turns. So every span is at least about half full but before a long turn or the end, and a window
exceeds the budget only if one turn with the system turn and the history does. Each window repeats the system turn (a first turn of
role ``system``) and, before its new turns, up to ``history`` tokens of the turns before
them. Only new assistant texts are under the loss mask; what is repeated is masked.

The template: ``<|turn|>role<|text|>text<|end|>\n``, with ``<|past|>`` for a repeated
turn. In roles and texts a backslash goes before every backslash, after ``<`` of
``<|``, ``<s>`` and ``</s>``, and after ``[`` of ``[INST]`` and ``[/INST]``; taking one
backslash off before any character undoes it. No control string of this template or of
those others remains inside a text.

Conversations of up to ``long_bytes`` are sorted each in one task, by one exchange. Longer ones, of
which there are at most as many as the table has multiples of that, are
sorted by range over all tasks, and each range of a conversation is a block. Sums run inside blocks,
then over the few rows that stand for a conversation's blocks, and the history that reaches over
a block's start is handed on to it. Both ways give the same windows. Only a single window's turns
are ever gathered in a row.

Defined cases: null and empty texts and roles count as empty. Turns are in order of
``turn``, nulls first, ties by role and text. A null conv_id is a conversation. Repeated
rows are turns of their own. Conversations without an assistant have an empty mask. An
empty table gives no windows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tessera.llm.staging import staged

BUDGET, HISTORY, LONG_BYTES = 2048, 256, 256 << 20
TURN, PAST, TEXT, END = "<|turn|>", "<|past|>", "<|text|>", "<|end|>\n"
_CONTROL = r"\\|(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"\\$0")


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def tokens(named: Column, said: Column) -> Column:
    """An estimate of a formatted turn: 4 for the template, one for four ASCII characters, one for a letter of two bytes, 1.75 and 2.5 for characters of three and four."""
    chars, octets = F.length(named) + F.length(said), F.octet_length(named) + F.octet_length(said)
    return (F.ceil((3 * octets - 2 * chars) / 4) + 4).cast("bigint")


def _in_one_sort(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """conv_id, window, new turns, turns before them and the system turn: each conversation in one task."""
    empty = F.lit("")
    t = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    t = t.select("conv_id", "role", F.row_number().over(order).cast("bigint").alias("n"), escape(t["role"]).alias("named"), escape(t["text"]).alias("said"))
    t = t.withColumns({"tokens": tokens(t["named"], t["said"]), "lead": (F.col("n") == 1) & (F.col("role") == "system")})
    by_n = Window.partitionBy("conv_id").orderBy("n")
    earlier = by_n.rowsBetween(Window.unboundedPreceding, -1)
    cost = F.when(F.col("lead"), 0).otherwise(F.col("tokens"))
    t = t.withColumns(
        {
            "at": F.coalesce(F.sum(cost).over(earlier), F.lit(0)),
            "fixed": F.max(F.when(F.col("lead"), F.col("tokens")).otherwise(0)).over(whole),
            "system": F.max(F.when(F.col("lead"), F.struct("named", "said"))).over(whole),
        }
    )
    t = t.withColumn("room", F.greatest(F.lit(1), F.lit(budget - history) - F.col("fixed")))
    long = 2 * cost > F.col("room")
    t = t.withColumns(
        {
            "long": long,
            "others": F.max(F.when(~long, cost).otherwise(0)).over(whole),
            "run": F.count_if(long).over(earlier),
            "since": F.coalesce(F.max(F.when(long, F.col("at") + cost)).over(earlier), F.lit(0)),  # where the run of other turns begins
        }
    )
    stretch = F.greatest(F.lit(1), F.col("room") - F.col("others"))
    place = F.when(F.col("long"), F.lit(1 << 62)).otherwise(F.floor((F.col("at") - F.col("since")) / stretch))
    t = t.withColumn("place", place)
    place = F.when(F.col("lead"), F.coalesce(F.lead("place").over(by_n), "place")).otherwise(F.col("place"))  # the system turn goes with the turn after it
    t = t.withColumn("span", F.struct("run", place.alias("place")))
    # the system turn has the place of the first turn after it, at 0, and is no history
    back = Window.partitionBy("conv_id").orderBy("at").rangeBetween(-history, -1)
    told = F.when(~F.col("lead"), F.struct("at", "named", "said"))
    t = t.withColumn("before", F.collect_list(told).over(back))
    first = F.col("n") == F.min("n").over(Window.partitionBy("conv_id", "span"))
    t = t.withColumn("before", F.when(first, F.col("before")))
    new = F.struct("n", "role", "named", "said")
    spans = t.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(new)).alias("new"), F.first("before", True).alias("before"), F.first("system").alias("system"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("span")) - 1
    return spans.select("conv_id", number.cast("bigint").alias("window"), "new", "before", "system")


def _ordered(turns: DataFrame) -> DataFrame:
    """conv (conv_id as a struct, so that null equals null), part, n (order over all), role, named, said (escaped), tokens.

    Ranges of the whole table are its parts, so a conversation of any length is cut into as
    many blocks, a (conv, part) each, as ranges meet it.
    """
    empty = F.lit("")
    t = turns.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    t = t.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv", "turn", "role", "text")
    t = t.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("n"), "role", escape(t["role"]).alias("named"), escape(t["text"]).alias("said"))
    return staged(t.withColumn("tokens", tokens(t["named"], t["said"])), "turns")


_BLOCK = ["conv", "part"]


def _in_block() -> WindowSpec:
    return Window.partitionBy(*_BLOCK).orderBy("n")


def _blocks() -> WindowSpec:
    return Window.partitionBy("conv").orderBy("part")


def _whole() -> WindowSpec:
    return Window.partitionBy("conv")


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _led(t: DataFrame, budget: int, history: int) -> DataFrame:
    """Per block: the conversation's system turn and its number, if it has one beside other turns, and the room."""
    system = F.col("role") == "system"
    first = F.struct("n", system.alias("is"), F.when(system, F.struct("named", "said")).alias("turn"), F.when(system, F.col("tokens")).alias("tokens"))
    blocks = t.groupBy(*_BLOCK).agg(F.min(first).alias("first"), F.count("*").alias("turns"))
    blocks = blocks.withColumns({"first": F.min("first").over(_whole()), "turns": F.sum("turns").over(_whole())})
    lead = lambda x: F.when(F.col("first.is") & (F.col("turns") > 1), F.col("first")[x])
    room = F.greatest(F.lit(1), F.lit(budget - history) - F.coalesce(lead("tokens"), F.lit(0)))
    return blocks.select(*_BLOCK, lead("n").alias("lead"), lead("turn").alias("system"), room.alias("room"))


def _within(t: DataFrame, blocks: DataFrame) -> DataFrame:
    """All turns but the system one with what their block knows of them: sums of the turns before."""
    t = t.join(blocks, _BLOCK).where("lead is null or lead <> n")
    if "begins" in blocks.columns:  # what is long goes with the block's first turn only
        t = t.withColumns({c: F.when(F.col("n") == F.col("begins"), F.col(c)) for c in ("system", "past")})
    long = 2 * F.col("tokens") > F.col("room")
    t = t.withColumns({"long": long, "at": F.coalesce(F.sum("tokens").over(_before(_in_block())), F.lit(0)), "run": F.count_if(long).over(_before(_in_block()))})
    return t.withColumn("since", F.max(F.when(F.col("long"), F.col("at") + F.col("tokens"))).over(_before(_in_block())))


def _summed(t: DataFrame, led: DataFrame) -> DataFrame:
    """Per block, beside what ``_led`` tells: the same sums over the conversation's blocks before it."""
    ends = F.max(F.when(F.col("long"), F.col("at") + F.col("tokens")))
    blocks = _within(t, led).groupBy(*_BLOCK).agg(
        F.sum("tokens").alias("size"), F.max(F.when(F.col("long"), 0).otherwise(F.col("tokens"))).alias("others"), F.count_if("long").alias("runs"), ends.alias("ends")
    )
    before = lambda x: F.coalesce(F.sum(x).over(_before(_blocks())), F.lit(0))
    blocks = blocks.select(*_BLOCK, "size", F.max("others").over(_whole()).alias("others"), before("size").alias("from_at"), before("runs").alias("from_run"), "ends")
    blocks = blocks.withColumn("from_since", F.max(F.col("from_at") + F.col("ends")).over(_before(_blocks()))).drop("ends")
    return staged(blocks.join(led, _BLOCK), "sums")


def _spans(t: DataFrame, blocks: DataFrame) -> DataFrame:
    """Turns with ``at`` in the conversation, ``span``, and whether the span differs from that of the block's turn before."""
    t = _within(t, blocks)
    t = t.withColumns({"at": F.col("from_at") + F.col("at"), "run": F.col("from_run") + F.col("run"), "since": F.col("from_at") + F.col("since")})
    since = F.coalesce(F.greatest("from_since", "since"), F.lit(0))  # where the run of other turns begins
    stretch = F.greatest(F.lit(1), F.col("room") - F.col("others"))
    place = F.when(F.col("long"), F.lit(1 << 62)).otherwise(F.floor((F.col("at") - since) / stretch))
    t = t.withColumn("span", F.struct("run", place.alias("place")))
    return t.withColumn("starts", ~F.col("span").eqNullSafe(F.lag("span").over(_in_block())))


def _numbered(t: DataFrame, blocks: DataFrame, history: int) -> DataFrame:
    """Per block, beside what ``_summed`` tells: how many windows began before it, whether its first goes on from there, and the turns before it that are history."""
    told = F.when(F.col("at") >= F.col("from_at") + F.col("size") - history, F.struct("at", "named", "said"))
    own = _spans(t, blocks).groupBy(*_BLOCK).agg(F.count_if("starts").alias("spans"), F.min("span").alias("first"), F.max("span").alias("last"), F.collect_list(told).alias("tail"), F.min("n").alias("begins"))
    goes_on = F.col("first").eqNullSafe(F.lag("last").over(_blocks())).cast("int")
    own = own.withColumn("goes_on", goes_on)
    # a turn has four tokens or more, so history reaches back over so many blocks at most
    near = _blocks().rowsBetween(-(history // 4 + 1), -1)
    own = own.select(*_BLOCK, "begins", "goes_on", F.coalesce(F.sum(F.col("spans") - F.col("goes_on")).over(_before(_blocks())), F.lit(0)).alias("windows"), F.flatten(F.collect_list("tail").over(near)).alias("past"))
    return staged(blocks.join(own, _BLOCK), "numbers")


def _in_blocks(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """The same of conversations of any length, over many tasks."""
    t = _ordered(turns)
    blocks = _numbered(t, _summed(t, _led(t, budget, history)), history)
    t = _spans(t, blocks)
    so_far = _in_block().rowsBetween(Window.unboundedPreceding, 0)
    nth = F.count_if("starts").over(so_far)
    t = t.withColumns({"window": F.col("windows") - F.col("goes_on") + nth - 1, "system": F.when(F.col("starts"), F.first("system", True).over(so_far))})
    back = Window.partitionBy(*_BLOCK).orderBy("at").rangeBetween(-history, -1)
    t = t.withColumn("near", F.collect_list(F.struct("at", "named", "said", "past")).over(back))
    # the block's first turn, which holds what came before it, is near where that is history
    past = F.coalesce("past", F.flatten(F.filter("near.past", lambda x: x.isNotNull())))
    before = F.concat(F.filter(past, lambda x: x["at"] >= F.col("at") - history), F.transform("near", lambda x: F.struct(x["at"].alias("at"), x["named"].alias("named"), x["said"].alias("said"))))
    t = t.withColumn("before", F.when(F.col("starts") & (F.col("window") >= F.col("windows")), before))
    new = F.struct("n", "role", "named", "said")
    spans = t.groupBy("conv", "window").agg(F.array_sort(F.collect_list(new)).alias("new"), F.first("before", True).alias("before"), F.first("system", True).alias("system"), F.first("lead", True).alias("lead"))
    first = F.array(F.struct(F.col("lead").alias("n"), F.lit("system").alias("role"), "system.named", "system.said"))
    led = (F.col("window") == 0) & F.col("lead").isNotNull()  # the system turn is new in the first window
    spans = spans.withColumn("new", F.when(led, F.concat(first, F.col("new"))).otherwise(F.col("new")))
    return spans.select("conv.conv_id", "window", "new", "before", "system")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, long_bytes: int = LONG_BYTES) -> DataFrame:
    """conv_id, window (from 0), formatted, loss (array of start, from 0, and length in code points)."""
    turns = turns.select("conv_id", "turn", "role", "text")
    conv = F.struct("conv_id").alias("conv")  # null equals null
    octets = 64 + F.coalesce(F.octet_length("role"), F.lit(0)) + F.coalesce(F.octet_length("text"), F.lit(0))
    sizes = turns.select(conv, octets.cast("bigint").alias("size")).groupBy("conv").agg(F.sum("size").alias("size"))
    if (sizes.agg(F.max("size")).first()[0] or 0) <= long_bytes:
        spans = _in_one_sort(turns, budget, history)
    else:
        long = staged(sizes.where(F.col("size") > long_bytes).select("conv"), "long")
        of = lambda how: turns.withColumn("conv", conv).join(long, "conv", how).drop("conv")
        spans = _in_one_sort(of("left_anti"), budget, history).unionByName(_in_blocks(of("left_semi"), budget, history))
    shown = lambda mark, x: F.concat(F.lit(mark), x["named"], F.lit(TEXT), x["said"], F.lit(END))
    again = F.when((F.col("window") > 0) & F.col("system").isNotNull(), shown(PAST, F.col("system"))).otherwise("")
    head = F.concat(again, F.array_join(F.transform(F.array_sort("before"), lambda x: shown(PAST, x)), ""))
    spans = spans.select("conv_id", "window", "new", head.alias("head"), F.transform("new", lambda x: shown(TURN, x)).alias("turns"))
    start = lambda x: F.length(F.lit(TURN)) + F.length(x["named"]) + F.length(F.lit(TEXT))
    ends = F.aggregate(
        "turns", F.array(F.length("head")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x)))
    )
    spans = spans.withColumn("ends", ends)
    mask = F.transform("new", lambda x, i: F.when(x["role"] == "assistant", F.struct((F.get("ends", i) + start(x)).alias("start"), F.length(x["said"]).alias("length"))))
    return spans.select("conv_id", "window", F.concat("head", F.array_join("turns", "")).alias("formatted"), F.filter(mask, lambda x: x.isNotNull()).alias("loss"))


def read_back(made: DataFrame) -> DataFrame:
    """Windows -> conv_id, turns_sha256 and so on, from the formatted strings and masks alone."""
    parts = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda x: F.startswith(x, F.lit(TURN)))
    body = lambda x: F.substr(x, F.lit(len(TURN) + 1))
    role = lambda x: unescape(F.substring_index(body(x), TEXT, 1))
    text = lambda x: unescape(F.substr(x, F.length(F.substring_index(x, TEXT, 1)) + len(TEXT) + 1))
    said = F.transform(parts, lambda x: F.concat(role(x), F.lit("\n"), text(x), F.lit("\n")))
    learnt = F.transform("loss", lambda x: unescape(F.substr("formatted", x["start"] + 1, x["length"])))
    one = made.select("conv_id", F.struct("window", F.array_join(said, "").alias("said"), F.array_join(learnt, "").alias("learnt")).alias("w"), F.size(parts).alias("n"), F.length("formatted").alias("chars"))
    all_of = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    loss = F.array_join("w.learnt", "")
    return all_of.select(
        "conv_id",
        F.col("n").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("chars").cast("bigint").alias("formatted_chars"),
    )
