"""Questions that meet rows of terms inside the tasks that read them, so that no pair of a question and a row is exchanged.

The questions' terms go to the tasks once, by number, each with the places of the questions that
have it.  A task meets its rows in blocks of bounded size and hands on counts or k rows a question.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows, and meetings of a row's term with a question, that a block has at most (one row may have more); cells that are counted side by side.
BLOCK_ROWS, BLOCK_MEETINGS, CELLS = 2048, 1_000_000, 1 << 22
#: Rows that wait at least before they are cut to the best.
WAITING = 1 << 18


class Asked:
    """Questions by place, and for each of their terms, by number, the places of those that have it.

    ids, wordings: a question's id and terms, of which there is one entry for each id.  words: all terms that are numbered, if not only those."""

    def __init__(self, ids: list[int], wordings: list[list[str]], own: list[list[str]] | None = None, gated: list[bool] | None = None, words: list[str] | None = None):
        self.ids, self.sizes = np.array(ids, np.int64), np.array([len(set(w)) for w in wordings], np.int64)
        self.gated = np.array(gated if gated is not None else [False] * len(ids), bool)
        self.words = sorted({t for w in (*wordings, *(own or [])) for t in w}) if words is None else words
        self.every = self._places(wordings)
        self.own = self.every if own is None else self._places(own)

    def _places(self, wordings: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        number = {t: i for i, t in enumerate(self.words)}
        pairs = np.array([(number[t], place) for place, w in enumerate(wordings) for t in set(w)], np.int64).reshape(-1, 2)
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        return np.searchsorted(pairs[:, 0], np.arange(len(self.words) + 1)), pairs[:, 1].copy()

    def numbers(self, lists: pa.ListArray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the terms in lists that questions have, in the order of rows; null lists have none."""
        found = pc.index_in(lists.flatten(), value_set=words)
        at = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(lists)), sizes)[at], found.take(pa.array(at)).to_numpy(zero_copy_only=False).astype(np.int64)

    def cuts(self, of_row: np.ndarray, numbers: np.ndarray, n_rows: int) -> Iterator[tuple[int, int]]:
        """Bounds of blocks of rows."""
        load = np.bincount(of_row, np.diff(self.every[0])[numbers], n_rows)
        at = 0
        while at < n_rows:
            end = at + max(1, int(np.searchsorted(np.cumsum(load[at : at + BLOCK_ROWS]), BLOCK_MEETINGS, "right")))
            yield at, min(end, n_rows)
            at = end

    def met(self, of_row: np.ndarray, numbers: np.ndarray, n_rows: int, weights: np.ndarray | None = None, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, place, count or sum of weights) of each row and question that share a term, by row and place."""
        starts, places = self.own if own else self.every
        n, asked = (starts[1:] - starts[:-1])[numbers], len(self.ids)
        at = np.arange(n.sum()) + np.repeat(starts[numbers] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n)
        codes = np.repeat(of_row, n) * asked + places[at]
        each = None if weights is None else np.repeat(weights, n)
        if n_rows * asked <= CELLS:
            shared = np.bincount(codes, minlength=n_rows * asked)
            found = np.flatnonzero(shared)
            value = shared[found] if each is None else np.bincount(codes, each, n_rows * asked)[found]
        else:
            found, inverse, shared = np.unique(codes, return_inverse=True, return_counts=True)
            value = shared if each is None else np.bincount(inverse, each, len(found))
        return found // asked, found % asked, value


class Kept:
    """The k best rows of each question so far: by falling score, then by the key's columns."""

    def __init__(self, k: int, asked: int, width: int):
        self.k, self.least = k, np.full(asked, -np.inf)
        self.rows = [(np.empty(0, np.int64), np.empty(0), np.empty((width, 0), np.int64))]
        self.waiting, self.most = 0, max(WAITING, 4 * k * asked)

    def add(self, place: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        through = score >= self.least[place]
        self.rows.append((place[through], score[through], key[:, through]))
        self.waiting += int(through.sum())
        if self.waiting > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place, score, key = (np.concatenate(x, axis=-1) for x in zip(*self.rows))
        order = np.lexsort((*key[::-1], -score, place))
        place, score, key = place[order], score[order], key[:, order]
        nth = np.arange(len(place)) - np.searchsorted(place, place)
        self.least[place[nth == self.k - 1]] = score[nth == self.k - 1]
        self.rows, self.waiting = [(place[nth < self.k], score[nth < self.k], key[:, nth < self.k])], 0
        return self.rows[0]

    def batch(self, ids: np.ndarray, names: list[str]) -> pa.RecordBatch:
        place, score, key = self.cut()
        return pa.RecordBatch.from_arrays([pa.array(ids[place]), *map(pa.array, key), pa.array(score)], names)


def asked_by(questions: DataFrame, own: Column, every: Column | None, gated: Column | None, most: int) -> Asked | None:
    """The questions (query_id, question), one row for each id, if they have at most `most` terms together; else None."""
    shown = questions.where("query_id is not null").select(
        F.col("query_id").cast("long").alias("id"), F.coalesce(own, F.array().cast("array<string>")).alias("own"), F.coalesce(own if every is None else every, F.array().cast("array<string>")).alias("every"),
        F.coalesce(F.lit(False) if gated is None else gated, F.lit(False)).alias("gated"))
    if (shown.agg(F.sum(F.size("own") + F.size("every"))).first()[0] or 0) > 2 * most:
        return None
    of: dict[int, tuple[set, set, bool]] = {}
    for r in shown.toLocalIterator():  # as few as counted
        held = of.get(r["id"], (set(), set(), False))
        of[r["id"]] = (held[0] | set(r["own"]), held[1] | set(r["every"]), held[2] or r["gated"])
    own_, every_, gated_ = zip(*of.values()) if of else ((), (), ())
    return Asked(list(of), list(every_), None if every is None else list(own_), list(gated_))


def numbered(rows: DataFrame, asked, key: list[str], found: Column) -> DataFrame:
    """(*key, n_terms, numbers): the rows that share a term with any question, with the numbers of those terms.

    asked: a broadcast Asked.  key: whole-number columns without nulls; found: distinct terms."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = asked.value
        words = pa.array(index.words, pa.string())
        for batch in batches:
            of_row, numbers = index.numbers(batch.column("terms"), words)
            kept, counts = np.unique(of_row, return_counts=True)
            part = batch.take(pa.array(kept))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(numbers.astype(np.int32)))
            sizes = pc.list_value_length(part.column("terms")).cast(pa.int32())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), sizes, lists], [*key, "n_terms", "numbers"])

    every = rows.select(*(F.col(c).cast("long").alias(c) for c in key), found.alias("terms"))
    return every.mapInArrow(number, ", ".join([*(f"{c} long" for c in key), "n_terms int", "numbers array<int>"]))


def overlaps(rows: DataFrame, asked, found: Column, least: int) -> DataFrame:
    """(query_id, hits, best): how many rows share `least` terms with each question that any row shares one with, and the most that one shares."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = asked.value
        words, hits, best = pa.array(index.words, pa.string()), np.zeros(len(index.ids), np.int64), np.zeros(len(index.ids), np.int64)
        for batch in batches:
            of_row, numbers = index.numbers(batch.column("terms"), words)
            for start, end in index.cuts(of_row, numbers, batch.num_rows):
                low, high = np.searchsorted(of_row, [start, end])
                _, place, shared = index.met(of_row[low:high] - start, numbers[low:high], end - start)
                np.maximum.at(best, place, shared)
                hits += np.bincount(place[shared >= least], minlength=len(hits))
        at = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(index.ids[at]), pa.array(hits[at]), pa.array(best[at])], ["query_id", "hits", "best"])

    each = rows.select(found.alias("terms")).mapInArrow(count, "query_id long, hits long, best long")
    return each.groupBy("query_id").agg(F.sum("hits").alias("hits"), F.max("best").alias("best"))


def best_scores(rows: DataFrame, asked, found: Column) -> DataFrame:
    """(query_id, score): the best score, shared terms over the root of a row's terms, of rows that have one of the question's own terms."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = asked.value
        words, best = pa.array(index.words, pa.string()), np.zeros(len(index.ids))
        for batch in batches:
            of_row, numbers = index.numbers(batch.column("terms"), words)
            root = np.sqrt(pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False))
            for start, end in index.cuts(of_row, numbers, batch.num_rows):
                low, high = np.searchsorted(of_row, [start, end])
                block = of_row[low:high] - start, numbers[low:high], end - start
                row, place, shared = index.met(*block)
                own_row, own_place, _ = index.met(*block, own=True)
                with_own = np.isin(row * len(best) + place, own_row * len(best) + own_place)
                row, place, shared = row[with_own], place[with_own], shared[with_own]
                np.maximum.at(best, place, shared / root[row + start])
        at = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(index.ids[at]), pa.array(best[at])], ["query_id", "score"])

    each = rows.select(found.alias("terms")).mapInArrow(score, "query_id long, score double")
    return each.groupBy("query_id").agg(F.max("score").alias("score"))


def holders(assets: DataFrame, asked, texts, found: Column) -> DataFrame:
    """(query_id, asset_id): the least asset whose body holds the question's whole text, of those that have all its terms.

    texts: a broadcast list of the questions' texts by place; assets (asset_id, body)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = asked.value
        words, least = pa.array(index.words, pa.string()), {}
        for batch in batches:
            of_row, numbers = index.numbers(batch.column("terms"), words)
            ids, bodies = batch.column("asset_id").to_numpy(), batch.column("body")
            for start, end in index.cuts(of_row, numbers, batch.num_rows):
                low, high = np.searchsorted(of_row, [start, end])
                row, place, shared = index.met(of_row[low:high] - start, numbers[low:high], end - start)
                every = shared == index.sizes[place]
                for r, p in zip((row[every] + start).tolist(), place[every].tolist()):
                    if ids[r] < least.get(p, ids[r] + 1) and texts.value[p] in bodies[r].as_py():
                        least[p] = int(ids[r])
        yield pa.RecordBatch.from_arrays([pa.array(index.ids[list(least)] if least else [], pa.int64()), pa.array(list(least.values()), pa.int64())], ["query_id", "asset_id"])

    each = assets.where("asset_id is not null").select(F.col("asset_id").cast("long").alias("asset_id"), "body", found.alias("terms")).mapInArrow(search, "query_id long, asset_id long")
    return each.groupBy("query_id").agg(F.min("asset_id").alias("asset_id"))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of an array column without nulls inside."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def affinities(facts: DataFrame, asked, k: int | None = None, digits: int = 6) -> DataFrame:
    """(query_id, asset_id, affinity) of the titles (asset_id, total, numbers, idfs) that share a term with a question: their weighed share.

    With k only the k best of each question, by rounded affinity and asset, with their rounded one; each task hands on k of a question at most."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = asked.value
        kept, names = Kept(k or 1, len(index.ids), 1), ["query_id", "asset_id", "affinity"]
        for batch in batches:
            of_row, numbers = _lists(batch.column("numbers"))
            ids, total, idfs = batch.column("asset_id").to_numpy(), batch.column("total").to_numpy(), _lists(batch.column("idfs"))[1]
            for start, end in index.cuts(of_row, numbers, batch.num_rows):
                low, high = np.searchsorted(of_row, [start, end])
                row, place, covered = index.met(of_row[low:high] - start, numbers[low:high], end - start, idfs[low:high], own=True)
                affinity = covered / total[row + start]
                if k:
                    kept.add(place, _rounded(affinity, digits), ids[None, row + start])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(index.ids[place]), pa.array(ids[row + start]), pa.array(affinity)], names)
        if k:
            yield kept.batch(index.ids, names)

    rows = facts.where("total > 0 and size(numbers) > 0").select(F.col("asset_id").cast("long").alias("asset_id"), "total", "numbers", "idfs")
    return rows.mapInArrow(share, "query_id long, asset_id long, affinity double")


def weighed_top_k(chunks: DataFrame, facts: DataFrame, blocks: list, wanted: list[tuple[float, int, int]], stale_factor: float = 1.0) -> DataFrame:
    """(query_id, asset_id, version_no, seq, score, nth): the best chunks of each question in each task, one row for equal ones of a version.

    blocks: a broadcast Asked for each part of the questions, which number the same words; each meets the rows in a pass, for which they are exchanged once.
    wanted: for each nth the strength of affinity, 1 for the best or -1 for the worst (of which score is the negative), and how many.

    chunks (asset_id, version_no, seq, same, n_terms, numbers) and facts (asset_id, total, numbers, idfs, review, stale) are dealt out by
    asset and sorted, so that an asset's facts come first and chunks with the same text follow each other by place; nothing is held but a block."""
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    left = chunks.select("asset_id", F.lit(1).alias("part"), "version_no", "same", "seq", "n_terms", "numbers", none("array<double>", "idfs"), none("double", "total"), F.lit(False).alias("review"), F.lit(False).alias("stale"))
    zero = F.lit(0).cast("long")
    right = facts.select(
        F.col("asset_id").cast("long").alias("asset_id"), F.lit(0).alias("part"), zero.alias("version_no"), zero.alias("same"), zero.alias("seq"), F.lit(1).alias("n_terms"), "numbers", "idfs", "total", "review", "stale")
    dealt = left.unionByName(right).repartition("asset_id").sortWithinPartitions("asset_id", "part", "version_no", "same", "seq")
    passes = [dealt.mapInArrow(_best_of(asked, wanted, stale_factor), "query_id long, asset_id long, version_no long, seq long, score double, nth int") for asked in blocks]
    return reduce(DataFrame.unionAll, passes)


def _best_of(asked, wanted: list[tuple[float, int, int]], stale_factor: float):
    """The pass of a block of questions over the rows that weighed_top_k() deals out."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = asked.value
        kept, carried, unit, seen = [Kept(k, len(index.ids), 3) for _, _, k in wanted], None, None, np.empty(0, np.int64)
        for whole in batches:
            # the facts of the asset that the last batch ended with come first again
            batch = whole if carried is None else pa.Table.from_batches([carried, whole]).combine_chunks().to_batches()[0]
            of_row, numbers = _lists(batch.column("numbers"))
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            asset, version, same, seq, is_fact = get("asset_id"), get("version_no"), get("same"), get("seq"), get("part") == 0
            root, total = np.sqrt(get("n_terms")), np.nan_to_num(get("total").astype(float))
            factor, review = np.where(get("stale"), stale_factor, 1.0), get("review")
            all_idfs = np.zeros(len(numbers))
            all_idfs[is_fact[of_row]] = _lists(batch.column("idfs"))[1]
            facts_at = np.maximum.accumulate(np.where(is_fact, np.arange(len(asset)), -1))
            facts_at[(facts_at >= 0) & (asset[facts_at] != asset)] = -1
            for start, end in index.cuts(of_row, numbers, len(asset)):
                low, high = np.searchsorted(of_row, [start, end])
                of, number = of_row[low:high], numbers[low:high]
                chunk = ~is_fact[of]
                row, place, shared = index.met(of[chunk] - start, number[chunk], end - start)
                row += start
                if not len(row):
                    continue
                at = facts_at[row]
                through = (at < 0) | ~(review[at] & index.gated[place])
                row, place, shared, at = row[through], place[through], shared[through], at[through]
                # of equal chunks of a version the first hit stays
                new = np.r_[True, (asset[1:] != asset[:-1]) | (version[1:] != version[:-1]) | (same[1:] != same[:-1]) | is_fact[1:] | is_fact[:-1]][start:end]
                group = np.cumsum(new) - 1
                codes = group[row - start] * len(index.ids) + place
                first = np.sort(np.unique(codes, return_index=True)[1])  # pairs stand by row
                inside = np.flatnonzero(~is_fact[start:end])
                unit_of = lambda i: (int(asset[start + i]), int(version[start + i]), int(same[start + i]))  # noqa: B023, E731
                if unit_of(inside[0]) == unit:  # goes on from the last block, in the same way of another batch
                    first = first[~((group[row[first] - start] == group[inside[0]]) & np.isin(place[first], seen))]
                of_tail = place[first][group[row[first] - start] == group[inside[-1]]]
                seen, unit = (np.union1d(seen, of_tail) if unit_of(inside[-1]) == unit else of_tail), unit_of(inside[-1])
                row, place, shared, at = row[first], place[first], shared[first], at[first]
                # title affinity, summed once for an asset
                used = np.unique(at[at >= 0])
                spans = [np.arange(a, b) for a, b in zip(*np.searchsorted(of_row, [used, used + 1]))]
                flat = np.concatenate([*spans, np.empty(0, np.int64)]).astype(np.int64)
                where = np.repeat(np.arange(len(used)), [len(s) for s in spans])
                holder, of_place, covered = index.met(where, numbers[flat], max(1, len(used)), all_idfs[flat], own=True)
                raised = np.zeros(len(row))
                if len(holder):
                    table, pair = holder * len(index.ids) + of_place, np.searchsorted(used, at) * len(index.ids) + place
                    found = np.minimum(np.searchsorted(table, pair), len(table) - 1)
                    hit = (at >= 0) & (table[found] == pair) & (total[at] > 0)
                    raised[hit] = covered[found[hit]] / total[at[hit]]
                lowered, keys = np.where(at >= 0, factor[at], 1.0), np.stack([asset[row], version[row], seq[row]])
                for best_of, (alpha, sign, _) in zip(kept, wanted):
                    best_of.add(place, sign * _rounded(shared / root[row] * ((1 + alpha * raised) * lowered), 9), keys)
            facts_row = int(facts_at[-1]) if len(facts_at) else -1
            carried = batch.slice(facts_row, 1) if facts_row >= 0 else None
        for nth, of in enumerate(kept):
            out = of.batch(index.ids, ["query_id", "asset_id", "version_no", "seq", "score"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, nth, np.int32))], [*out.schema.names, "nth"])

    return best


def covering(groups: DataFrame, asked, group: str, k: int) -> DataFrame:
    """(query_id, group, coverage): the k groups (group, numbers) with most of each question's terms in each task, ties by group."""

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = asked.value
        kept = Kept(k, len(index.ids), 1)
        for batch in batches:
            of_row, numbers = _lists(batch.column("numbers"))
            ids = batch.column(group).to_numpy()
            for start, end in index.cuts(of_row, numbers, batch.num_rows):
                low, high = np.searchsorted(of_row, [start, end])
                row, place, shared = index.met(of_row[low:high] - start, numbers[low:high], end - start)
                kept.add(place, shared / index.sizes[place], ids[None, row + start])
        yield kept.batch(index.ids, ["query_id", group, "coverage"])

    return groups.select(group, "numbers").mapInArrow(cover, f"query_id long, {group} long, coverage double")
