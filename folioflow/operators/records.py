"""Record linkage: DOI groups, blocked pairs, gap filling, verification and merging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.shared import cut, discard


def norm_doi(c: Column) -> Column:
    """Resolver prefix off, lower case, trailing ``/`` and ``.`` off."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(F.trim(c), r"^https?://doi\.org/", ""))), r"[/.]+$", "")


def words(c: Column) -> Column:
    """Distinct words of a title: lower case, everything but letters, digits and blanks deleted."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^a-z0-9 ]", ""), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two distinct arrays; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def surnames(c: Column) -> Column:
    """Last word of each author in a list split at ``;`` , ``,`` or ``and``; letters and digits, two or more."""
    last = F.transform(F.split(c, r"; *|, *| and "), lambda x: F.regexp_replace(F.lower(F.element_at(F.split(F.trim(x), " +"), -1)), r"[^a-z0-9]", ""))
    return F.array_distinct(F.filter(last, lambda x: F.length(x) >= 2))


def doi_groups(works: DataFrame) -> DataFrame:
    """One row per DOI (published before forthcoming before working paper, then longer abstract, then smaller id) with its
    sources. Aggregates partially, so a common DOI is no hot task.

    Cases: rows whose DOI is null, blank or nothing but a resolver's address pass through as groups of one, under ``#``
    and their id; a null abstract counts as empty, a null journal as published; null sources are in no list.
    """
    journal = F.lower(F.coalesce("journal", F.lit("")))
    tier = F.when(journal.contains("working paper"), 2).when(journal.contains("forthcoming"), 1).otherwise(0)
    key = F.coalesce(norm_doi(F.col("doi")), F.lit(""))
    keyed = works.withColumn("doi_key", F.when(key == "", F.concat(F.lit("#"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).otherwise(key))
    rank = F.struct(tier, -F.length(F.coalesce("abstract", F.lit(""))), F.col("doc_id"))
    return keyed.groupBy("doi_key").agg(F.min_by("doc_id", rank).alias("winner"), F.count(F.lit(1)).alias("n_records"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def _packed(c: Column | str) -> Column:
    """Words as one string, which travels in half the bytes of an array; null if there are none."""
    return F.nullif(F.array_join(c, " "), F.lit(""))


def _unpacked(c: str) -> Column:
    return F.coalesce(F.split(c, " "), F.array())


def word_classes(rows: DataFrame, id_col: str, words_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows of equal word sets as one: classes (rep, words) under the smallest id, and members (rep, id) but for ``rep``
    itself. Rows without words are in neither. Words hold no blank: sets travel as one string, and are written, so that
    the words of a row are taken once."""
    sets = cut(rows.select(F.col(id_col).alias("id"), _packed(F.array_sort(words_col)).alias("set")), "sets").where("set is not null")
    classes = cut(sets.groupBy("set").agg(F.min("id").alias("rep")), "classes")
    members = sets.join(classes, "set").where("id <> rep").select("rep", "id")
    return classes.select("rep", F.split("set", " ").alias("words")), members


#: Longs of a word set's signature; how many words before its own a head carries; heads and pairs of a step.
LONGS, BEFORE = 8, 4
HEADS, PAIRS = 200_000, 1_000_000


def _meetings(share: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (i, j) of the heads of a word (see :func:`met_pairs`), which come by word and size."""
    least = share / (1 + share)

    def of_words(heads: pa.Table) -> Iterator[pa.RecordBatch]:
        rep = heads["rep"].combine_chunks()
        w, n, left = (heads[c].to_numpy().astype(np.int64) for c in ("w", "n", "left"))
        # Unsigned, as numpy counts the bits of absolute values.
        bits = [heads[f"b{k}"].to_numpy().view(np.uint64) for k in range(LONGS)]
        rows = np.arange(len(w))
        # A word that isn't there equals none, so each stands for a number of its own, beyond all hashes.
        before = [np.where(v.isna(), (1 << 33) + rows, v.fillna(0)).astype(np.int64) for v in (heads[f"before{k}"].to_pandas() for k in range(BEFORE))]
        group = np.cumsum(np.r_[0, w[1:] != w[:-1]])
        size = int(n.max()) + 2
        # A head meets those after it, of its size or larger, as far as enough of its own words are left.
        most = np.clip(np.ceil((left + 1e-9) / least - n) - 1, 0, size - 1).astype(np.int64)
        most += (most + 1 < size) & ((n + most + 1) * least - 1e-9 < left)
        stop = np.maximum(np.searchsorted(group * size + n, group * size + most, side="right"), rows + 1)
        upto = np.cumsum(stop - rows - 1)
        lo = 0
        while lo < len(rows):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PAIRS, side="right")))
            counts = (stop - rows - 1)[lo:hi]
            one = np.repeat(rows[lo:hi], counts)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(counts) - counts, counts)
            lo = hi
            there = left[two] > (n[one] + n[two]) * least - 1e-9
            one, two = one[there], two[there]
            room = (n[one] + n[two]) * (1 - 2 * least) + 1e-9
            for b in bits:
                room -= np.bitwise_count(b[one] ^ b[two])
                one, two, room = one[room > 0], two[room > 0], room[room > 0]
            met = np.zeros(len(one), dtype=bool)
            for x in before:
                for y in before:
                    met |= x[one] == y[two]
            pairs = np.unique(np.stack([one[~met], two[~met]], 1), axis=0)
            x, y = rep.take(pa.array(pairs[:, 0])), rep.take(pa.array(pairs[:, 1]))
            first = pc.less(x, y)
            yield pa.RecordBatch.from_arrays([pc.if_else(first, x, y), pc.if_else(first, y, x)], ["i", "j"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held, count = [*held, batch], count + batch.num_rows
            if count >= HEADS and batch.num_rows and held[0]["w"][0] != batch["w"][-1]:
                table = pa.Table.from_batches(held)
                w = table["w"].to_numpy()
                # The last word may go on in the next batch.
                whole = int(np.searchsorted(w, w[-1]))
                yield from of_words(table.slice(0, whole))
                held, count = table.slice(whole).to_batches(), len(w) - whole
        if count:
            yield from of_words(pa.Table.from_batches(held))

    return run


def met_pairs(classes: DataFrame, share: float) -> DataFrame:
    """``(i, j)``, i < j: all classes (rep, words) whose words' Jaccard exceeds ``share``, and few others.

    Words, as hashes, are ordered from rare to common. Two similar sets share one of the first n - floor(share * n) of each,
    its heads, and where they first meet enough words must be left on both sides; common words stand last, so they rarely
    pair anything. The heads of a word are compared where they meet, in arrays, so that only pairs that pass travel on: a
    word turns over one of 512 bits of its set, hence two sets differ in at least as many words as bits. A pair is left out
    where one of the four words just before is common too, as it meets there or earlier; so pairs come a few times, not once
    a common word. Words of one hash count as one, which lets more pairs pass and loses none.
    """
    each = classes.select("rep", F.explode(F.transform("words", lambda w: F.hash(w))).alias("w"))
    rarity = each.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    bits = [F.expr(f"bit_xor(if((shiftrightunsigned(w, 6) & {LONGS - 1}) = {k}, shiftleft(1L, w & 63), 0L))").alias(f"b{k}") for k in range(LONGS)]
    ordered = each.join(rarity, "w").groupBy("rep").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "w"))), lambda x: x["w"]).alias("o"), *bits)
    n = F.size("o")
    placed = ordered.select("rep", n.alias("n"), "o", *[f"b{k}" for k in range(LONGS)], F.posexplode(F.slice("o", F.lit(1), (n - F.floor(n * share)).cast("int"))).alias("p", "w"))
    before = [F.get("o", F.col("p") - 1 - k).alias(f"before{k}") for k in range(BEFORE)]
    heads = placed.select("rep", "w", "n", (F.col("n") - F.col("p")).alias("left"), *[f"b{k}" for k in range(LONGS)], *before)
    kind = classes.schema["rep"].dataType.simpleString()
    return heads.repartition("w").sortWithinPartitions("w", "n").mapInArrow(_meetings(share), f"i {kind}, j {kind}").distinct()


def similar_pairs(classes: DataFrame, share: float = 0.4) -> DataFrame:
    """``(i, j)``, i < j, of the classes whose words' Jaccard exceeds ``share``; none is lost and no stop word is skipped:
    the :func:`met_pairs`, decided by their words. Words hold no blank, as they travel as one string."""
    one, two = (classes.select(F.col("rep").alias(k), _packed("words").alias(f"w{k}")) for k in "ij")
    met = met_pairs(classes, share).join(one, "i").join(two, "j")
    return met.where(jaccard(_unpacked("wi"), _unpacked("wj")) > share).select("i", "j")


def first_links(rows: DataFrame, id_col: str, keys_col: str) -> DataFrame:
    """``(k, i, j)``: for every element k of its array, each row j linked to the smallest id i that has k too. So the rows of
    an element are i and its j, in as many links as rows and elements rather than in all pairs.

    Cases: null arrays and elements link nothing; repeated rows give their links once; an element of one row has no link.
    """
    each = rows.select(F.col(id_col).alias("j"), F.explode(F.array_distinct(keys_col)).alias("k")).where("k is not null")
    return each.join(each.groupBy("k").agg(F.min("j").alias("i")), "k").where("i < j").select("k", "i", "j").distinct()


def first_of_either_key(rows: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """``rows`` without each row that shares a key with an earlier kept one, exactly as one pass in ``order`` decides.

    ``order`` must be unique. Null and empty keys match nothing. Every round keeps the rows that come first among the
    undecided of all their keys and drops those that share a key with a kept row, by partial minima; a round is written
    before the next. Rounds are as many as the longest chain of such decisions, two or three as a rule.
    """
    named = [F.when(F.col(k) != "", F.concat(F.lit(f"{n}:"), F.col(k).cast("string"))) for n, k in enumerate(keys)]
    left = cut(rows.select(F.col(order).alias("o"), F.array_compact(F.array(*named)).alias("ks")), "either")
    kept = left.where("size(ks) = 0").select("o")
    left = left.where("size(ks) > 0")
    while True:
        each = left.select("o", F.explode("ks").alias("k"))
        least = each.groupBy("k").agg(F.min("o").alias("m"))
        leads = each.join(least, "k").groupBy("o").agg(F.bool_and(F.col("o") == F.col("m")).alias("lead"))
        marked = cut(left.join(leads, "o"), "either")
        won = marked.where("lead")
        kept = kept.unionByName(won.select("o"))
        taken = won.select(F.explode("ks").alias("k")).distinct()
        others = marked.where("not lead").select("o", "ks")
        gone = others.select("o", F.explode("ks").alias("k")).join(taken, "k", "left_semi").select("o").distinct()
        left = cut(others.join(gone, "o", "left_anti"), "either")
        if left.isEmpty():
            return rows.join(kept.withColumnRenamed("o", order), order, "left_semi").select(*rows.columns)


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """``(i, j, verdict)``, i < j: of the verdicts (a, b, verdict, ord) on a pair, in either order, the last one. Those with
    a null id or on a work and itself are ignored; of equal ``ord``, the last verdict by name counts."""
    canonical = verdicts.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), "verdict", "ord").where("a <> b")
    return canonical.groupBy("i", "j").agg(F.max(F.struct("ord", "verdict")).alias("last")).select("i", "j", F.col("last.verdict").alias("verdict"))


def allowed_verdicts(works: DataFrame, verdicts: DataFrame, share: float = 0.4) -> DataFrame:
    """The :func:`last_verdicts` on pairs of ``works`` (id, words, names) that may be compared: those with a surname in
    common or titles of more than ``share`` common words.

    The rule is tried on each given pair, found by its two ids, so pairs of a common surname are never listed. Cases:
    unknown ids are ignored; null words and names have nothing in common; a null verdict stays null. Words hold no blank.
    """
    one, two = (works.select(F.col("id").alias(k), _packed("words").alias(f"w{k}"), F.coalesce("names", F.array()).alias(f"n{k}")) for k in "ij")
    met = last_verdicts(verdicts).join(one, "i").join(two, "j")
    name = F.coalesce(F.arrays_overlap(F.col("ni"), F.col("nj")), F.lit(False))
    return met.where(name | (jaccard(_unpacked("wi"), _unpacked("wj")) > share)).select("i", "j", "verdict")


def verdict_join(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pairs (i, j) with their :func:`last_verdicts`: unexpected verdicts are ignored, missing and null ones are ``no``."""
    return pairs.join(last_verdicts(verdicts), ["i", "j"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("no")))


def gap_fill(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """One row per key: each field's first non-blank value in order."""
    first = [F.min_by(F.col(f), F.when(F.trim(f) != "", F.col(order))).alias(f) for f in fields]
    blank_to_null = [F.nullif(F.trim(F.col(f)), F.lit("")).alias(f) for f in fields]
    return rows.groupBy(key).agg(*first).select(key, *blank_to_null)


def fill_missing(rows: DataFrame, index: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Left lookup in ``index``: only missing fields are filled."""
    other = index.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return rows.join(other, key, "left").withColumns({f: F.coalesce(F.nullif(F.trim(F.col(f)), F.lit("")), F.col(f"__{f}")) for f in fields}).drop(*[f"__{f}" for f in fields])


def audit_status(entries: DataFrame, index: DataFrame) -> DataFrame:
    """Best index hit of each entry over shared words: ``verified`` over 0.85, ``hallucinated`` under 0.5 but not 0,
    otherwise ``unverified``. ``entries`` and ``index`` have (id, words); hits are met through their words only."""
    e, x = entries.select("id", F.explode("words").alias("w")), index.select(F.col("id").alias("hit"), F.explode("words").alias("w"), F.size("words").alias("n_hit"))
    shared = e.join(x, "w").groupBy("id", "hit").agg(F.count(F.lit(1)).alias("both"), F.first("n_hit").alias("n_hit"))
    sized = shared.join(entries.select("id", F.size("words").alias("n")), "id").withColumn("similarity", F.col("both") / (F.col("n") + F.col("n_hit") - F.col("both")))
    best = sized.groupBy("id").agg(F.max("similarity").alias("similarity"))
    scored = entries.select("id").join(best, "id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    status = F.when(F.col("similarity") > 0.85, "verified").when((F.col("similarity") < 0.5) & (F.col("similarity") > 0), "hallucinated").otherwise("unverified")
    return scored.select("id", F.round("similarity", 6).alias("similarity"), status.alias("status"))


def resolve_ids(notes: DataFrame, text: str, order: str, is_short: Column, work: str) -> DataFrame:
    """Each short form takes the work of the nearest note before it that is none (null if that one has no work)."""
    before = Window.partitionBy(text).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~is_short, F.struct(F.col(work).alias("w"))), ignorenulls=True).over(before)["w"]
    return notes.withColumn("resolved", F.when(is_short, last).otherwise(F.col(work)))


def garbled_runs(lines: DataFrame, removable: Column, junk: Column, blank: Column) -> DataFrame:
    """Lines (doc_id, line_no, line) without runs of debris: six or more removable lines in a row (blank ones may lie
    between), two or more of them junk; a run goes from its first to its last removable line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    stop = F.when(~(removable | blank), 1).otherwise(0)
    marked = lines.withColumn("run", F.sum(stop).over(order)).withColumn("debris", removable & ~blank)
    kept = marked.where("debris").groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n"), F.count_if(junk).alias("n_junk"), F.min("line_no").alias("lo"), F.max("line_no").alias("hi"))
    bad = kept.where("n >= 6 and n_junk >= 2")
    gone = marked.join(bad, ["doc_id", "run"], "left").where(~F.coalesce(F.col("line_no").between(F.col("lo"), F.col("hi")), F.lit(False)))
    return gone.select("doc_id", "line_no", "line")
