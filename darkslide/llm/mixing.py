"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions alone.

A source that is to give p times its words takes every document floor(p) times and the rest, a fraction equal for all its documents,
by dependent rounding. Two documents with fractional copies are a pair: words move from one to the other, in the direction and by
the amount drawn at random that leave each one's expectation as it is, until one of the two has a whole number of copies. The other goes on to
the next pair. What a pair holds together never changes, so a source's words miss its target by less than one document.

Pairs are made in a reduction tree: documents are dealt to buckets of about BUCKET of their source and of a size within a factor of two, each bucket is
folded to one fractional document, and these are dealt to buckets of the next level, until at most BUCKET of each size are left. These are folded
by source from the longest to the shortest, so what is fractional in the end is mostly short. A source of n documents needs
log n / log BUCKET levels, and however large it is, it is spread over n / BUCKET buckets. Random numbers are hashes of the document and the
level, so reruns agree.

Defined results: a null text has no words; documents without words are taken 0 times as they add nothing; a null source is a source of its own, the
last; rows that are equal in key, source and size are interchangeable and all stay; an empty table gives an empty result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from darkslide.operators.ranking import rank_all, rank_in_large_groups
from darkslide.plans.session import materialize, unused_name

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Documents of a bucket on average; a bucket is one array in memory.
BUCKET = 64
#: Sources up to which their table (some 60 bytes a row) is broadcast.
BROADCAST_SOURCES = 50_000
#: Equal rows that one task numbers at once.
RUN = 1024

_SPACE = " \t\n\x0b\x0c\r"


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text; every word and the space after it shrink to one letter, so no list of words is made."""
    left = F.ltrim(F.coalesce(text.cast("string"), F.lit("")), F.lit(_SPACE))
    return F.char_length(F.regexp_replace(left, "[^\\x20\\x09-\\x0D]++[\\x20\\x09-\\x0D]*+", "x")).cast("long")


def uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def octave(size: Column) -> Column:
    """Number of binary digits of a size."""
    return F.length(F.regexp_replace(F.bin(size), "^0$", "")).cast("int")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, s (its number in order of code points, null last), source_size, n (rows with words by octave of their size), target of each
    source of (source, size, m: rows of that size).

    Targets share all words by weight; those over `most` times their source stay there and the rest is shared among the others, until
    none is over. Each round is one aggregate over the sources; the level of a unit of weight only rises."""
    words = F.col("size") * F.col("m")
    octaves = sizes.groupBy("source", octave(F.col("size")).alias("cls")).agg(F.sum(words).alias("words"), F.sum("m").alias("m"))
    totals = octaves.groupBy("source").agg(F.sum("words").alias("source_size"), F.map_from_entries(F.collect_list(F.struct("cls", "m"))).alias("n"))
    numbered = rank_all(totals, [F.col("source").asc_nulls_last()], "s")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    t = materialize(numbered.withColumn("_w", weight), "mix-sources")
    limit = F.col("source_size") * F.lit(float(most))
    total, weighed = t.agg(F.sum("source_size"), F.sum("_w")).first()
    level = (total or 0) / (weighed or 1)
    before = 0
    while True:
        over = F.col("_w") * F.lit(level) > limit
        n, words_over, left = t.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("_w")))).first()
        if n == before or not left:
            break
        before, level = n, (total - words_over) / left
    return t.withColumn("target", F.least(F.col("_w") * F.lit(level), limit)).drop("_w")


def beside_sources(rows: DataFrame, sources: DataFrame, on: Column) -> DataFrame:
    """rows with the columns of their source; a table of at most BROADCAST_SOURCES sources goes to all tasks, a larger one is joined by
    shuffle, where Spark splits the partitions of a large source."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, on)


def numbered_rows(classes: DataFrame, m: str = "m") -> DataFrame:
    """A row with `copy` = 0, 1, ... for each of the m equal rows that a row of classes stands for. Runs of RUN are dealt out first, so
    rows of one class are made by many tasks."""
    runs = classes.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({m} - 1) div {RUN}"))))
    dealt = runs.repartition(*[c for c in runs.columns if c != m])
    last = F.least(F.col(m) - 1, F.col("_run") * RUN + (RUN - 1))
    return dealt.withColumn("copy", F.explode(F.sequence(F.col("_run") * RUN, last))).drop("_run", m)


def _fold(items: Column, key_type: str) -> Column:
    """carry, done of a bucket's items (o, k, size, copy, x, w) in order of o: the last fractional document, and the others with their
    whole number (up: 1 or 0)."""
    carry_type, done_type = f"struct<k:{key_type},size:bigint,copy:bigint,x:double>", f"array<struct<k:{key_type},size:bigint,copy:bigint,up:int>>"
    state = lambda t, x: F.struct(t["k"].alias("k"), t["size"].alias("size"), t["copy"].alias("copy"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)).alias("x"))
    settled = lambda t, up: F.array(F.struct(t["k"].alias("k"), t["size"].alias("size"), t["copy"].alias("copy"), F.lit(up).alias("up")))

    def pair(acc: Column, it: Column) -> Column:
        c = acc["carry"]
        # words by which one can rise and the other fall, whichever comes to its end first
        moves = F.struct((c["size"] * (1 - c["x"])).alias("c_up"), (it["size"] * it["x"]).alias("it_down"), (c["size"] * c["x"]).alias("c_down"), (it["size"] * (1 - it["x"])).alias("it_up"))

        def settle(m: Column) -> Column:
            up, down = F.least(m["c_up"], m["it_down"]), F.least(m["c_down"], m["it_up"])
            rises = it["w"] * (up + down) < down
            case = lambda rest, x, done, to: F.struct(state(rest, x).alias("carry"), F.concat(acc["done"], settled(done, to)).alias("done"))
            return (
                F.when(rises & (m["c_up"] <= m["it_down"]), case(it, it["x"] - up / it["size"], c, 1))
                .when(rises, case(c, c["x"] + up / c["size"], it, 0))
                .when(m["c_down"] <= m["it_up"], case(it, it["x"] + down / it["size"], c, 0))
                .otherwise(case(c, c["x"] - down / c["size"], it, 1))
            )

        first = F.struct(state(it, it["x"]).alias("carry"), acc["done"].alias("done"))
        return F.when(c.isNull(), first).otherwise(F.get(F.transform(F.array(moves), settle), F.lit(0)))

    start = F.struct(F.lit(None).cast(carry_type).alias("carry"), F.array().cast(done_type).alias("done"))
    return F.aggregate(items, start, pair)


def pivotal(rows: DataFrame, seed: int, most_rows: int) -> DataFrame:
    """s, k, size, copy, up (0 or 1) for rows (s: source, n: rows of that source and octave of sizes, k, size, copy, x: fraction, unique by s, k,
    size, copy). most_rows is the largest n. The tables of the levels stay in the shared folder, as the result reads them."""
    key_type = rows.schema["k"].dataType.simpleString()
    name = [F.col("s"), F.col("k"), F.col("size"), F.col("copy")]
    buckets = lambda n: F.expr(f"({n} + {BUCKET - 1}) div {BUCKET}")
    state = ["s", "cls", "k", "size", "copy", "x"]

    def fold(t: DataFrame, by: list[str], tag: str, *first: Column) -> DataFrame:
        items = F.struct(*first, F.xxhash64(F.lit(seed), F.lit("order"), F.lit(tag), *name).alias("o"), "k", "size", "copy", "x", uniform(seed, F.lit("pair"), F.lit(tag), *name).alias("w"))
        folded = t.groupBy(*by).agg(F.sort_array(F.collect_list(items)).alias("items"))
        return materialize(folded.select(*by, _fold(F.col("items"), key_type).alias("f")), "mix-level")

    settled = lambda t: t.select("s", F.explode("f.done").alias("d")).select("s", "d.k", "d.size", "d.copy", "d.up")
    rows = rows.withColumn("cls", octave(F.col("size")))
    few = F.col("n") <= BUCKET
    done, ready = [], [rows.where(few).select(*state)]
    pending = rows.where(~few).withColumn("_nb", buckets("n"))
    pending = pending.withColumn("_b", F.pmod(F.xxhash64(F.lit(seed), F.lit("bucket"), *name), "_nb")).drop("n")
    level = 0
    while most_rows > BUCKET:
        table = fold(pending, ["s", "cls", "_nb", "_b"], f"level {level}")
        done.append(settled(table))
        left = table.select("s", "cls", "_nb", "_b", "f.carry.k", "f.carry.size", "f.carry.copy", "f.carry.x")
        ready.append(left.where(f"_nb <= {BUCKET}").select(*state))
        pending = left.where(f"_nb > {BUCKET}").withColumn("_b", F.expr(f"_b div {BUCKET}")).withColumn("_nb", buckets("_nb"))
        most_rows = -(-most_rows // BUCKET)
        level += 1
    last = fold(reduce(DataFrame.unionByName, ready), ["s"], "last", (-F.col("size")).alias("longest"))
    rest = last.select("s", "f.carry.k", "f.carry.size", "f.carry.copy", "f.carry.x")
    done += [settled(last), rest.select(*name, (uniform(seed, F.lit("rest"), *name) < F.col("x")).cast("int").alias("up"))]
    return reduce(DataFrame.unionByName, done)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """key, source, size, copy, source_size, target, copies, taken for each row of docs; copy numbers rows that are equal in key, source and size."""
    slim = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    sizes = materialize(slim.groupBy("source", "k", "size").agg(F.count("*").alias("m")), "mix-sizes")
    sources = source_targets(sizes, weights, most)
    share = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    sources = sources.withColumns({"base": F.floor(share), "x": share - F.floor(share)})
    sources = materialize(sources.select(F.col("source").alias("_source"), "s", "source_size", "n", "target", "base", "x"), "mix-targets")
    most_rows = sources.agg(F.max(F.array_max(F.map_values("n")))).first()[0] or 0
    slim_sources = sources.select("_source", "s", "n", "x")
    rows = beside_sources(sizes, slim_sources, F.col("source").eqNullSafe(F.col("_source")))
    rows = rows.select("s", F.element_at("n", octave(F.col("size"))).alias("n"), "k", "size", "m", "x")
    # the large class of a source with empty documents is dealt out like any other
    fractional = (F.col("size") > 0) & (F.col("x") > 0)
    whole = numbered_rows(rows.where(~fractional)).select("s", "k", "size", "copy", F.lit(0).alias("up"))
    rounded = pivotal(numbered_rows(rows.where(fractional)), seed, most_rows)
    numbers = sources.select(F.col("s").alias("_s"), F.col("_source").alias("source"), "source_size", "target", "base")
    out = beside_sources(whole.unionByName(rounded), numbers, F.col("s") == F.col("_s"))
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("up")).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("copies", copies)
    return out.select(F.col("k").alias(key), "source", "size", "copy", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixture(docs: DataFrame, planned: DataFrame | None = None, key: str = "doc_id", source: str = "source", text: str = "text", **given: object) -> DataFrame:
    """The mixed corpus: the rows of docs, all columns as they are, each as often as the plan takes it."""
    planned = planned if planned is not None else plan(docs, key=key, source=source, text=text, **given)
    size, number, rank = unused_name(docs, "_size"), unused_name(docs, "_copy"), unused_name(docs, "_hash")
    rows = docs.withColumns({size: word_count(F.col(text)), rank: F.xxhash64(F.col(text))})
    rows = rank_in_large_groups(rows, [key, source, size], [F.col(rank)], number)
    p = planned.where("copies > 0").select(F.col(key).alias("_pk"), F.col("source").alias("_ps"), F.col("size").alias("_pz"), (F.col("copy") + 1).alias("_pc"), "copies")
    same = rows[key].eqNullSafe(p["_pk"]) & rows[source].cast("string").eqNullSafe(p["_ps"]) & (rows[size] == p["_pz"]) & (rows[number] == p["_pc"])
    times = F.explode(F.sequence(F.lit(1).cast("long"), p["copies"]))
    return rows.join(p, same).select(*(rows[c] for c in docs.columns), times.alias(unused_name(docs, "_time"))).select(*docs.columns)
