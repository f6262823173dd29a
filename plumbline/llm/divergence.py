"""How far the sources of a language differ in their terms, by a heavy-light split.

A source's share of a term is a smoothed whole number (billionths, see
``_share``), the same for all terms that the source lacks. The distance of two
sources is the sum of the absolute differences over all kept terms. Kept terms
are split by the sources that use them.

* Heavy: used by at least ``HEAVY_PERCENT`` of the language's sources. Tiles of
  terms x sources are filled and all pairs of sources of a tile summed in numpy,
  less what these terms would add if neither source had them.
* Light: used by few. With z(g) for the share of a term that g lacks, A(g, z) for
  the sum of abs(share - z) over the light terms that g has, n(g) for their
  number and L for the number of all light terms, the light sum of g and h is

      A(g, z(h)) + A(h, z(g)) + abs(z(g) - z(h)) * (L - n(g) - n(h)) + corrections

  where L counts the heavy terms too, for what their tiles are less, and a light term that both have is corrected by
  abs(p - q) - abs(p - z(h)) - abs(q - z(g)) + abs(z(g) - z(h)). A comes from
  running sums over the sorted shares of g, the corrections from the postings of
  each light term. So no light term costs more than the square of its few
  sources, summed up within a task.

All sums are whole numbers of 64 bits (a share is at most 10^9 + 1, the shares
of a source sum up to about 10^9 plus the number of terms), hence exact in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import small_or_shuffled, stored, with_text_batches

#: Bytes of UTF-8 text: capital letters become small ones, what is neither a letter nor part of another character a blank.
FOLDED = bytes(i if i >= 0x80 or 0x61 <= i <= 0x7A else i + 32 if 0x41 <= i <= 0x5A else 0x20 for i in range(256))
LEAST_DOCS, PRIOR, SCALE, TERMS_SHOWN = 30, 5, 1_000_000_000, 50
#: Percent of a language's sources from which on a term is heavy.
HEAVY_PERCENT = 25
#: Sources of a side of a tile, and postings of a task's terms.
SIDE, POSTINGS = 256, 20_000
#: Differences that numpy holds at a time; terms that a task holds before they become rows, and rows of a batch.
HELD, HELD_TERMS, BATCH = 2_000_000, 500_000, 50_000
#: Parts into which a language's sources are dealt where each meets all others.
SALTS = 16


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of group, term and counts from rows of group and text; at most about ``HELD`` terms are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            if text.is_valid:
                counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(counts)
                words = text.as_py().translate(FOLDED).split()
                counts.update(words)
                docs.update(set(words))
                size += len(counts)
            if size >= HELD_TERMS:
                yield from _rows(held)
                size = 0
    yield from _rows(held)


def _rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """The counted terms in batches; the tables are emptied."""
    for (lang, source), (counts, docs) in held.items():
        terms = pa.array(counts.keys(), pa.binary(), size=len(counts)).cast(pa.string())
        numbers, rows = pa.array(counts.values(), pa.int64(), size=len(counts)), pa.array(map(docs.__getitem__, counts), pa.int64(), size=len(counts))
        for at in range(0, len(terms), BATCH):
            part = terms.slice(at, BATCH)
            groups = [pa.repeat(pa.scalar(x), len(part)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*groups, part, numbers.slice(at, BATCH), rows.slice(at, BATCH)], ["lang", "source", "term", "c", "docs"])
    held.clear()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, term, c, docs``: occurrences of each term and the rows that hold it.

    Tasks count what they read before the shuffle, so a source with a third of
    all documents is no task of its own.
    """
    rows = _grouped(docs, lang, source, F.col(text).cast("string").alias("text"))
    counted = with_text_batches(rows).mapInArrow(_counted, "lang string, source string, term string, c long, docs long")
    return counted.repartition("lang", "source", "term").groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def _grouped(docs: DataFrame, lang: str, source: str, *more: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), *more)


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)) in decimals; 0 without terms."""
    part = f"(cast({SCALE} AS DECIMAL(10,0)) * (cast({count} AS DECIMAL(19,0)) + {PRIOR}))"
    whole = f"(cast({total} AS DECIMAL(19,0)) + {PRIOR} * cast(terms AS DECIMAL(19,0)))"
    return F.expr(f"CASE WHEN terms > 0 THEN 1 + ({part} div {whole}) ELSE 0 END").cast("long")


def _names(docs: DataFrame, lang: str, source: str) -> DataFrame:
    """``lang, source, g, groups``: every occurring group, its number in its language and how many that has."""
    each = Window.partitionBy("lang")
    return _grouped(docs, lang, source).distinct().withColumns({"g": F.row_number().over(each.orderBy("source")) - 1, "groups": F.count("*").over(each)})


def _kept_terms(counts: DataFrame, names: DataFrame) -> DataFrame:
    """``lang, term, term_id, q, terms, lang_total, heavy, slice``: terms of enough rows with their share of the language.

    A slice holds about ``POSTINGS`` (term, source) pairs of one kind and language.
    """
    kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"), F.count("*").alias("sources")).where(F.col("docs") >= LEAST_DOCS)
    kept = stored(kept.join(F.broadcast(names.select("lang", "groups").distinct()), "lang").withColumn("heavy", 100 * F.col("sources") >= HEAVY_PERCENT * F.col("groups")), "terms")
    slices = F.ceil(F.sum("sources") / POSTINGS).cast("int")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("c").alias("lang_total"))
    of_kind = kept.groupBy("lang", "heavy").agg(slices.alias("slices"))
    kept = kept.join(of_lang, "lang").join(of_kind, ["lang", "heavy"])
    return kept.select("lang", "term", F.monotonically_increasing_id().alias("term_id"), _share("c", "lang_total").alias("q"), "terms", "lang_total", "heavy", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"))


def _tile_sums(heavy: bool, a: np.ndarray, b: np.ndarray, term: np.ndarray, g: np.ndarray, p: np.ndarray, z: np.ndarray) -> np.ndarray:
    """What some terms, given by their postings in the sources a and b, add to the pairs (a[i], b[j]); z is indexed by source."""
    out = np.zeros((len(a), len(b)), np.int64)
    if not len(term):
        return out
    order = np.argsort(term, kind="stable")
    term, g, p = term[order], g[order], p[order]
    _, t = np.unique(term, return_inverse=True)
    za, zb = z[a], z[b]
    step = max(1, HELD // max(len(a) * len(b), len(a) + len(b))) if heavy else max(1, HELD // (len(a) + len(b)))
    place_a, place_b = np.full(len(z), -1), np.full(len(z), -1)
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    for first in range(0, t[-1] + 1, step):
        lo, hi = np.searchsorted(t, [first, first + step])
        many = min(step, t[-1] + 1 - first)
        row, who, value = t[lo:hi] - first, g[lo:hi], p[lo:hi]
        left, right = place_a[who] >= 0, place_b[who] >= 0
        if heavy:
            x, y = np.tile(za, (many, 1)), np.tile(zb, (many, 1))
            x[row[left], place_a[who[left]]] = value[left]
            y[row[right], place_b[who[right]]] = value[right]
            out += np.abs(x[:, :, None] - y[:, None, :]).sum(axis=0) - many * np.abs(za[:, None] - zb[None, :])
            continue
        # postings of a against those of b of the same term: each left posting repeats for the term's right ones
        lrow, li, lp = row[left], place_a[who[left]], value[left]
        rrow, rj, rp = row[right], place_b[who[right]], value[right]
        starts, stops = np.searchsorted(rrow, lrow), np.searchsorted(rrow, lrow, side="right")
        sizes = stops - starts
        edges = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + HELD, side="right")) - 1)
            n = sizes[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(n.sum()) - np.repeat(edges[at:to] - edges[at], n) + np.repeat(starts[at:to], n)
            gi, hj, x, y = li[i], rj[j], lp[i], rp[j]
            more = np.abs(x - y) - np.abs(x - zb[hj]) - np.abs(y - za[gi]) + np.abs(za[gi] - zb[hj])
            np.add.at(out, (gi, hj), more)
            at = to
    return out


def _pair_sums(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, g, h, value`` in both directions: heavy sums and light corrections of pairs that share a task's terms.

    Postings are dealt by language, slice of terms and pair of blocks of
    ``SIDE`` sources; one z of each source of the two blocks goes with them.
    """
    blocks = F.expr(f"cast((groups - 1) div {SIDE} AS int)")
    own = F.expr(f"cast(g div {SIDE} AS int)")
    others = F.transform(F.sequence(F.lit(0), blocks), lambda b: F.struct(F.least(own, b).alias("a"), F.greatest(own, b).alias("b")))
    rows = postings.select("lang", "slice", "heavy", "term_id", "g", "p", F.explode(others).alias("tile")).select("lang", "slice", "heavy", "term_id", "g", "p", "tile.a", "tile.b")
    sides = groups.select("lang", "g", "z", F.explode(others).alias("tile")).select("lang", "g", "z", "tile.a", "tile.b")
    needed = rows.select("lang", "slice", "heavy", "a", "b").distinct()
    sides = needed.join(sides, ["lang", "a", "b"]).select("lang", "slice", "heavy", F.lit(None).cast("long").alias("term_id"), "g", F.col("z").alias("p"), "a", "b")

    def sums(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lang, _, heavy, block_a, block_b = key
        is_side = pdf["term_id"].isna().to_numpy()
        who, value = pdf["g"].to_numpy(np.int64), pdf["p"].to_numpy(np.int64)
        sides = np.unique(who[is_side])
        z = np.zeros(int(sides.max()) + 1, np.int64)
        z[who[is_side]] = value[is_side]
        a, b = sides[sides // SIDE == block_a], sides[sides // SIDE == block_b]
        made = _tile_sums(bool(heavy), a, b, pdf["term_id"][~is_side].to_numpy(np.int64), who[~is_side], value[~is_side], z)
        i, j = np.nonzero(made)
        if block_a == block_b:
            i, j = i[i != j], j[i != j]
            g, h = a[i], b[j]
            value = made[i, j]
        else:
            g, h = np.concatenate([a[i], b[j]]), np.concatenate([b[j], a[i]])
            value = np.concatenate([made[i, j]] * 2)
        return pd.DataFrame({"lang": lang, "g": g, "h": h, "value": value})

    return rows.unionByName(sides).groupBy("lang", "slice", "heavy", "a", "b").applyInPandas(sums, "lang string, g int, h int, value long")


def _sums_at(shares: DataFrame, pairs: DataFrame) -> DataFrame:
    """``lang, g, h, value``: A(g, z(h)) of each pair, from running sums over the sorted light shares of g and the z of all others."""
    known = shares.where(~F.col("heavy")).groupBy("lang", "g", F.col("p").alias("v")).agg(F.count("*").alias("n")).withColumn("h", F.lit(None).cast("int"))
    asked = pairs.select("lang", "g", F.col("z_h").alias("v"), F.lit(0).cast("long").alias("n"), "h")
    each = Window.partitionBy("lang", "g")
    upto = each.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = known.unionByName(asked).withColumns({"below": F.sum("n").over(upto), "below_v": F.sum(F.col("n") * F.col("v")).over(upto), "all": F.sum("n").over(each), "all_v": F.sum(F.col("n") * F.col("v")).over(each)})
    value = F.col("v") * F.col("below") - F.col("below_v") + (F.col("all_v") - F.col("below_v")) - F.col("v") * (F.col("all") - F.col("below"))
    return rows.where("h is not null").select("lang", "g", "h", value.alias("value"))


def pair_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, g, h, value``: the distance of each source g to each other source h of its language."""
    light = shares.where(~F.col("heavy")).groupBy("lang", "g").agg(F.count("*").alias("n"))
    each = groups.join(light, ["lang", "g"], "left").fillna(0, ["n"])
    left = each.select("lang", "g", "z", "n", "terms", F.pmod("g", F.lit(SALTS)).alias("_salt"))
    right = each.select("lang", F.col("g").alias("h"), F.col("z").alias("z_h"), F.col("n").alias("n_h"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    pairs = left.join(right, ["lang", "_salt"]).where("g <> h")
    base = pairs.select("lang", "g", "h", (F.abs(F.col("z") - F.col("z_h")) * (F.col("terms") - F.col("n") - F.col("n_h"))).alias("value"))
    sums = _sums_at(shares, pairs)
    turned = sums.select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value")
    return base.unionByName(sums).unionByName(turned).unionByName(_pair_sums(shares, groups)).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def divergences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Return ``lang, source, part, item, value, rank``: distances to the other sources, and the terms that a source uses more than its language.

    Null texts, languages and sources are empty ones; a group without terms has
    its rows of distances like any other (all 0 in a language without kept
    terms). Texts of any length are counted whole, repeated rows as often as
    they occur (each is a row that holds its terms); other columns are ignored;
    an empty table gives an empty result. Ties go to the item with smaller bytes.
    """
    counts = stored(term_counts(docs, text, lang, source), "terms")
    names = stored(_names(docs, lang, source), "sources")
    kept = stored(_kept_terms(counts, names), "kept")
    postings = stored(counts.select("lang", "source", "term", "c").join(kept, ["lang", "term"]), "postings")
    totals = postings.groupBy("lang", "source").agg(F.sum("c").alias("total"))
    of_lang = kept.groupBy("lang").agg(F.max("terms").alias("terms"))
    groups = names.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "terms"])
    groups = stored(groups.select("lang", "source", "g", "groups", "terms", "total", _share("0", "total").alias("z")), "groups")
    many = groups.count()
    beside = small_or_shuffled(groups.select("lang", "source", "g", "groups", "total"), many)
    shares = stored(postings.join(beside, ["lang", "source"]).select("lang", "source", "term", "term_id", "slice", "heavy", "g", "groups", "q", _share("c", "total").alias("p")), "shares")
    distances = pair_distances(shares, groups)
    for column, name in (("g", "source"), ("h", "item")):
        distances = distances.join(small_or_shuffled(groups.select("lang", F.col("g").alias(column), F.col("source").alias(name)), many), ["lang", column])
    each = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = distances.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(each).alias("rank"))
    more = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = more.withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= TERMS_SHOWN).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
