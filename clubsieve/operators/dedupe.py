"""Order-dependent duplicate detection, exact and in bounded memory.

Both walks below are sequential by definition. Pairs within a URL: records stream through in order, and only
one open record per key is remembered; in large URLs, keys that agree with none but their copies need no walk.
Groups of a block: records are first folded to one row per run of equal keys, which is a partial aggregate; the
walk sees distinct keys, and its answer is joined back to the records.
"""
from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as fv, keys
from ..session import settle
from .matching import SEPARATOR, value_of
from .merge import merge_groups
from .ranking import rank_in_groups, top_n


def _same_fields(a: tuple, b: tuple) -> int:
    """Fields that agree; null agrees with everything."""
    return sum(x is None or y is None or x == y for x, y in zip(a, b))


def walk_sorted(df: DataFrame, keys: list[str], order: list, walk, schema: str) -> DataFrame:
    """Runs a sequential walk per group over rows that arrive sorted.

    Rows stream through in Arrow batches, so a group is never held as a whole; `walk(key)` gives
    an object whose step(row) returns output rows, and which holds what it must remember.
    """
    columns = df.columns
    names = [part.split()[0] for part in schema.split(", ")]
    at = [columns.index(k) for k in keys]

    def run(batches):
        current, walker = None, None
        for pdf in batches:
            out = []
            for row in zip(*[pdf[c].tolist() for c in columns]):
                key = tuple(row[i] for i in at)
                if key != current:
                    current, walker = key, walk(key)
                out.extend(walker.step(dict(zip(columns, row))))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


@lru_cache(maxsize=None)
def must_agree(shared: int) -> tuple[int, ...]:
    """Which sets of fields, as masks, can make two records agree on four of six, given the fields filled in both.

    A field that is null on one side agrees, so all but two of the shared fields must be equal.
    """
    bits = [1 << i for i in range(len(fv.SIX_KEY_FIELDS)) if shared >> i & 1]
    free = len(fv.SIX_KEY_FIELDS) - fv.DUPLICATE_REVIEW_FROM
    return tuple(sum(picked) for picked in combinations(bits, max(len(bits) - free, 0)))


@lru_cache(maxsize=None)
def places_of(mask: int) -> tuple[int, ...]:
    return tuple(i for i in range(len(fv.SIX_KEY_FIELDS)) if mask >> i & 1)


#: So many open records of a URL are tried one by one; of more, the ones that may agree are looked up.
FEW_OPEN = 16


class PairWalk:
    """Greedy pairing of one URL: each record takes the oldest open one that it agrees with, else stays open.

    That gives the same pairs as letting each record take its first later partner: of two open records the
    older one comes first either way. Two records of one key agree, so at most one of each key is open, and
    no more is remembered. Open records are found by the values they must share, for each filled pattern
    among them; such an index is made when it is first asked for.
    """

    def __init__(self, key):
        self.url = key[0]
        self.count = 0
        self.open: dict[int, tuple] = {}
        self.by_mask: dict[int, set[int]] = {}
        self.index: dict[tuple[int, int], dict[tuple, dict[int, None]]] = {}

    def first(self, fields, mask):
        """The oldest open record that agrees on four fields or more; entries of an index are in order of age."""
        if len(self.open) <= FEW_OPEN:
            return next((serial for serial, (other, _, _) in self.open.items() if _same_fields(other, fields) >= fv.DUPLICATE_REVIEW_FROM), None)
        best = None
        for other in self.by_mask:
            for equal in must_agree(mask & other):
                places = self.index.get((other, equal))
                if places is None:
                    places = self.index[other, equal] = {}
                    for serial in sorted(self.by_mask[other]):
                        places.setdefault(tuple(self.open[serial][0][i] for i in places_of(equal)), {})[serial] = None
                found = places.get(tuple(fields[i] for i in places_of(equal)))
                if found:
                    oldest = next(iter(found))
                    best = oldest if best is None else min(best, oldest)
        return best

    def _indexes(self, fields, mask):
        for (other, equal), places in self.index.items():
            if other == mask:
                yield places, tuple(fields[i] for i in places_of(equal))

    def step(self, row):
        fields = [row[f"f{i}"] for i in range(len(fv.SIX_KEY_FIELDS))]
        mask = sum(1 << i for i, x in enumerate(fields) if x is not None)
        serial = self.first(fields, mask)
        if serial is None:
            self.open[self.count] = (fields, mask, row["league_id"])
            self.by_mask.setdefault(mask, set()).add(self.count)
            for places, value in self._indexes(fields, mask):
                places.setdefault(value, {})[self.count] = None
            self.count += 1
            return
        other, other_mask, keep = self.open.pop(serial)
        self.by_mask[other_mask].discard(serial)
        for places, value in self._indexes(other, other_mask):
            del places[value][serial]
            if not places[value]:
                del places[value]
        yield (self.url, keep, row["league_id"], _same_fields(tuple(other), tuple(fields)))


#: From so many records on a URL is paired over all tasks.
BIG_URL = 50_000
#: Rounds for the keys of large URLs that are in no clique; what is open then is walked.
ROUNDS = 12
#: A round that settles less than this share of the open records is the last one.
LEAST_SETTLED = 1 / 16

FIELDS = [f"f{i}" for i in range(len(fv.SIX_KEY_FIELDS))]


@lru_cache(maxsize=None)
def weighed_sets(shared: int) -> tuple[tuple[int, int], ...]:
    """Sets of shared fields with weights. Over the sets that two keys are equal on, the weights sum to 1 where the
    keys agree and to 0 where not (inclusion and exclusion)."""
    bits = [1 << i for i in range(len(FIELDS)) if shared >> i & 1]
    least = max(len(bits) - len(FIELDS) + fv.DUPLICATE_REVIEW_FROM, 0)
    if not least:
        return ((0, 1),)
    return tuple((sum(picked), (-1) ** (k - least) * comb(k - 1, least - 1))
                 for k in range(least, len(bits) + 1) for picked in combinations(bits, k))


MEET = ["url", "equal", "value", "mask", "other"]


def _looks(rows: DataFrame) -> DataFrame:
    """Each distinct key once for every filled pattern of its URL (64 at most) and every set of values (22 at most).

    Which fields two keys must share depends only on which ones each has filled, so keys meet by equality: one of mask
    a looks among those of mask b under (a, b), and is found by them under (b, a).
    """
    mask = sum((F.when(F.col(f).isNotNull(), 1 << i).otherwise(0) for i, f in enumerate(FIELDS)), F.lit(0))
    keys = rows.select("url", "key", *FIELDS).distinct().withColumn("mask", mask)
    patterns = keys.select("url", F.col("mask").alias("other")).distinct()
    sets = F.array(*[F.array(*[F.struct(F.lit(s).alias("equal"), F.lit(w).alias("weight")) for s, w in weighed_sets(shared)])
                     for shared in range(1 << len(FIELDS))])
    return (keys.join(patterns, "url").withColumn("set", F.explode(F.element_at(sets, F.col("mask").bitwiseAND(F.col("other")) + 1)))
            .select("url", "key", "mask", "other", "set.equal", "set.weight", value_of(FIELDS, F.col("set.equal")).alias("value")))


def _found(per_place: DataFrame) -> DataFrame:
    """What is known of the keys of a place, under the names by which others look there."""
    swapped = {"mask": "other", "other": "mask"}
    return per_place.select(*[F.col(c).alias(swapped.get(c, c)) for c in per_place.columns])


def _cliques(looks: DataFrame) -> DataFrame:
    """(url, key, clique) of the keys whose neighbours all have the same neighbours, a key alone included.

    A key's number of neighbours and the sum of their hashes come from the counts and sums of the places where it
    looks, without a pair being listed. Keys of equal sums have the same neighbours, themselves included; where there
    are as many of them as neighbours, they are each other's. Sums are taken over 64-bit hashes.
    """
    named = looks.withColumn("hash", F.xxhash64("key").cast("decimal(20,0)"))
    held = _found(named.groupBy(*MEET).agg(F.count("*").alias("n"), F.sum("hash").alias("hashes")))
    around = named.join(held, MEET).groupBy("url", "key").agg(
        F.sum(F.col("weight") * F.col("n")).alias("degree"), F.sum(F.col("weight") * F.col("hashes")).alias("clique"))
    alike = around.groupBy("url", "clique", "degree").agg(F.count("*").alias("keys"))
    return around.join(alike, ["url", "clique", "degree"]).filter("keys = degree").select("url", "key", "clique")


def _agreeing(a: str, b: str) -> Column:
    """Fields of two structs that agree; null agrees with everything."""
    return sum((F.coalesce(F.col(f"{a}.{f}") == F.col(f"{b}.{f}"), F.lit(True)).cast("int") for f in FIELDS), F.lit(0))


def _neighbours_in_order(ranked: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """First and second, third and fourth record of each group and so on, without gathering it; ranks start at 1."""
    record = F.struct("league_id", *FIELDS)
    both = ranked.groupBy(*keys, F.floor((rank - 1) / 2).alias("pair")).agg(
        F.count("*").alias("n"), F.min_by(record, rank).alias("a"), F.max_by(record, rank).alias("b"))
    return both.filter("n = 2").select("url", F.col("a.league_id").alias("keep_id"), F.col("b.league_id").alias("archive_id"), _agreeing("a", "b").alias("matched"))


def _in_rounds(records: DataFrame, looks: DataFrame, rounds: int, few: int) -> tuple[DataFrame | None, DataFrame]:
    """Pairs that are final, and the records that `rounds` rounds leave open, or fewer rounds once `few` are open.

    A pair is final when each is the other's first open partner; the same pairs come out as in a walk. All copies of
    a key agree with each other and with the same others, so only the first open record (head) of each key can meet
    one of another key, and the copies before the first head of all neighbours pair among themselves at once. Keys
    lose records from the front only: a round's state is one number per key. `records` has rank (within the URL) and
    place (within the key), both from 1.
    """
    looks = looks.filter("weight = 1")
    state = records.select("url", "key").distinct().withColumn("done", F.lit(0).cast("long"))
    pairs = None
    for _ in range(rounds):
        still = records.join(state, ["url", "key"]).filter("place > done")
        mine = looks.join(still.groupBy("url", "key").agg(F.min("rank").alias("head")), ["url", "key"])
        # The first two heads of a place, as a key must not find itself.
        firsts = _found(top_n(mine.select(*MEET, "head"), MEET, ["head"], 2).groupBy(*MEET).agg(F.min("head").alias("a"), F.max("head").alias("b")))
        other = F.when(F.col("a") != F.col("head"), F.col("a")).when(F.col("b") != F.col("head"), F.col("b"))
        near = mine.join(firsts, MEET).groupBy("url", "key").agg(F.min("head").alias("head"), F.min(other).alias("first"))
        now = settle(still.join(near, ["url", "key"]).groupBy("url", "key", "done", "head", "first").agg(
            F.count("*").alias("open"), F.count_if(F.col("first").isNull() | (F.col("rank") < F.col("first"))).alias("before"))
            .withColumn("own", F.col("before") - F.col("before") % 2))
        own = _neighbours_in_order(records.join(now.filter("own > 0").select("url", "key", "done", "own"), ["url", "key"])
                                   .filter("place > done AND place <= done + own"), ["url", "key"], F.col("place") - F.col("done"))
        waiting = now.filter("own = 0 AND first IS NOT NULL")
        met = settle(waiting.select("url", "head", "first").join(
            waiting.select("url", F.col("head").alias("first"), F.col("first").alias("head")), ["url", "head", "first"], "left_semi"))
        record = lambda name, at: records.select("url", F.col("rank").alias(at), F.struct("league_id", *FIELDS).alias(name))
        crossed = (met.filter("head < first").join(record("a", "head"), ["url", "head"]).join(record("b", "first"), ["url", "first"])
                   .select("url", F.col("a.league_id").alias("keep_id"), F.col("b.league_id").alias("archive_id"), _agreeing("a", "b").alias("matched")))
        final = settle(own.unionByName(crossed))
        pairs = final if pairs is None else pairs.unionByName(final)
        taken = F.when(F.col("own") > 0, F.col("own")).otherwise(F.coalesce(F.col("met"), F.lit(0)))
        after = now.join(met.select("url", "head", F.lit(1).alias("met")), ["url", "head"], "left").withColumn("taken", taken)
        after = settle(after.select("url", "key", (F.col("done") + F.col("taken")).alias("done"), "first", "open", "taken"))
        # Keys without an open neighbour are through.
        state = after.filter("first IS NOT NULL AND open > taken").select("url", "key", "done")
        count = after.agg(F.sum("open").alias("open"), F.sum("taken").alias("taken")).first()
        if not count["taken"] or count["open"] - count["taken"] < few or count["taken"] < count["open"] * LEAST_SETTLED:
            break
    return pairs, records.join(state, ["url", "key"]).filter("place > done")


def _pairs_of_large(rows: DataFrame, rounds: int, few: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of whole large URLs, cliques by rank and the other keys in rounds, and the records that stay open."""
    order = [F.desc("score"), "league_id"]
    looks = settle(_looks(rows))
    cliques = settle(_cliques(looks))
    in_cliques = rank_in_groups(rows.join(cliques, ["url", "key"]).select("url", "clique", "score", "league_id", *FIELDS), ["url", "clique"], order)
    pairs = _neighbours_in_order(in_cliques, ["url", "clique"], F.col("rank"))
    others = rows.join(cliques, ["url", "key"], "left_anti")
    ranked = rank_in_groups(rank_in_groups(others, ["url"], order), ["url", "key"], ["rank"], "place")
    final, rest = _in_rounds(settle(ranked), looks.join(cliques, ["url", "key"], "left_anti"), rounds, few)
    return pairs if final is None else pairs.unionByName(final), rest.select("url", "league_id", "score", *FIELDS)


def duplicate_pairs(df: DataFrame, url: str = "url_scraped", big: int = BIG_URL, rounds: int = ROUNDS) -> DataFrame:
    """Duplicate pairs within each URL: (url, keep_id, archive_id, matched_fields, confidence).

    Takes each URL by quality, equal scores by id, a number or a text. Every record takes the first later one that
    agrees on at least four of six fields (null agrees), and each is in one pair at most. Five or six agreeing
    fields give AUTO, four REVIEW. Records without an id cannot be named and are left out.

    The rule is sequential. The records of a small URL stream through one task in order, which remembers one open
    record per key. In a URL with `big` records or more, keys that all agree with each other are paired by rank, and
    the others in rounds of pairs that are each other's first; only what stays open after `rounds` rounds is walked.
    The result is the same for any `big` and `rounds`.
    """
    lowered = [F.lower(F.col(f).cast("string")).alias(name) for name, f in zip(FIELDS, fv.SIX_KEY_FIELDS)]
    rows = df.filter("league_id is not null").select(F.col(url).alias("url"), "league_id", F.coalesce("quality_score", F.lit(0)).cast("int").alias("score"), *lowered)
    kind = rows.schema["league_id"].dataType.simpleString()
    schema = f"url string, keep_id {kind}, archive_id {kind}, matched int"
    walked = lambda some: walk_sorted(some, ["url"], [F.desc("score"), "league_id"], PairWalk, schema)
    large = settle(rows.groupBy("url").count().filter(F.col("count") >= big).select(F.col("url").alias("big_url")))
    if large.isEmpty():
        pairs = walked(rows)
    else:
        # A null and an empty value must stay apart.
        key = F.concat_ws(SEPARATOR, *[F.coalesce(F.concat(F.lit("="), F.col(f)), F.lit("")) for f in FIELDS])
        of_large = settle(rows.join(large, F.col("url") == F.col("big_url"), "left_semi").withColumn("key", key))
        small = rows.join(large, F.col("url") == F.col("big_url"), "left_anti")
        found, rest = _pairs_of_large(of_large, rounds, big // 50)
        pairs = walked(small.unionByName(rest)).unionByName(found)
    # Settled, so that no caller walks twice.
    return settle(pairs).select("url", "keep_id", "archive_id", F.col("matched").alias("matched_fields"),
                        F.when(F.col("matched") >= fv.DUPLICATE_AUTO_FROM, "AUTO").otherwise("REVIEW").alias("confidence"))


def duplicate_groups_of_urls(df: DataFrame) -> DataFrame:
    """The pairs with both records attached."""
    record = lambda name: df.select(F.col("league_id").alias(f"{name}_id"), F.struct(*df.columns).alias(name))
    return duplicate_pairs(df).join(record("keep"), "keep_id").join(record("archive"), "archive_id")


N_KEYS = len(fv.KEY_FIELDS)


def _overlap(a: list, b: list) -> int:
    """Equal filled fields, or -1 on any conflict."""
    n = 0
    for x, y in zip(a, b):
        if x is not None and y is not None:
            if x != y:
                return -1
            n += 1
    return n


class GroupWalk:
    """Group of each distinct key of a block, in order of first appearance, named by its first record.

    A key joins the first group it matches; the group then takes over the fields it lacked.
    Failing that, a page that is parent or child of the group's first page may join on the same
    sport with a single shared field. A key with too few fields does not even match its own
    copies: where it opens a group, only its first record is in it (solo).
    """

    def __init__(self, key):
        self.key = key
        self.groups: list[list] = []
        self.firsts: list[tuple] = []
        self.heads: list[int] = []
        # Group numbers by field value, and the ones that lack the field.
        self.having: list[dict] = [{} for _ in range(N_KEYS)]
        self.lacking: list[set[int]] = [set() for _ in range(N_KEYS)]
        self.by_page: dict = {}
        self.by_parent: dict = {}

    def candidates(self, key):
        """Groups that may match, in order: a match has the key's value, or none, in every filled
        field, so the field with the fewest such groups is enough."""
        best = None
        for f, v in enumerate(key):
            if v is not None:
                size = len(self.having[f].get(v, ())) + len(self.lacking[f])
                if best is None or size < best[0]:
                    best = (size, f, v)
        return sorted(self.having[best[1]].get(best[2], set()) | self.lacking[best[1]]) if best else []

    def relatives(self, page, parent, sport):
        """Groups whose first page is the parent or a child of this page, with the same sport."""
        linked = self.by_page.get(parent, set()) | self.by_parent.get(page, set()) if parent is not None else self.by_parent.get(page, set())
        return [n for n in sorted(linked) if sport is not None and self.firsts[n] == sport]

    def step(self, rec):
        key = [rec[f"f{i}"] for i in range(N_KEYS)]
        page, parent = rec["page"], rec["parent"]
        at = next((n for n in self.candidates(key) if _overlap(key, self.groups[n]) >= 3), None)
        if at is None:
            at = next((n for n in self.relatives(page, parent, key[1]) if _overlap(key, self.groups[n]) >= 1), None)
        opened = at is None
        if opened:
            at = len(self.groups)
            self.groups.append([None] * N_KEYS)
            self.firsts.append(key[1])
            self.heads.append(rec["first_id"])
            self.by_page.setdefault(page, set()).add(at)
            if parent is not None:
                self.by_parent.setdefault(parent, set()).add(at)
            for lacking in self.lacking:
                lacking.add(at)
        group = self.groups[at]
        for f, v in enumerate(key):
            if group[f] is None and v is not None:
                group[f] = v
                self.lacking[f].discard(at)
                self.having[f].setdefault(v, set()).add(at)
        yield (*self.key, rec["value"], self.heads[at], opened and sum(k is not None for k in key) < 3)


def assign_groups(df: DataFrame, block: str = "base_domain", page: str = "url_scraped",
                  parent_map: DataFrame | None = None, sequence: str = "league_id") -> DataFrame:
    """(league_id, group_id): which records of a block are one listing.

    Records with equal keys and pages are taken together at the place of their first one, so the
    walk sees distinct keys only. A block is also cut by every field that all of its records
    have: records that differ there can never match.
    """
    named = [f"f{i}" for i in range(N_KEYS)]
    rows = keys.known_keys(df, dict(zip(fv.KEY_FIELDS, named)), "league_id", F.col(block).alias("block"),
                           F.col(page).alias("page"), F.col(sequence).alias("seq"))
    if parent_map is None:
        rows = rows.withColumn("parent", F.lit(None).cast("string"))
    else:
        known = parent_map.groupBy(F.col("child_url").alias("page")).agg(F.min("parent_url").alias("parent"))
        rows = rows.join(known, "page", "left")
    # Three branches read the rows; settled, their keys are normalised once and not in each of them.
    rows = settle(rows)
    always = rows.groupBy("block").agg(*[F.bool_and(F.col(n).isNotNull()).alias(f"all_{n}") for n in named])
    text = lambda n: F.coalesce(F.concat(F.lit("="), F.col(n)), F.lit(""))
    value = F.concat_ws("\u0001", *[text(n) for n in named], F.col("page"))
    fixed = F.concat_ws("\u0001", *[F.when(F.col(f"all_{n}"), text(n)).otherwise("") for n in named])
    rows = rows.join(always, "block").withColumns({"value": value, "fixed": fixed})
    distinct = rows.groupBy("block", "fixed", "value").agg(
        F.min("seq").alias("seq"), F.min_by("league_id", "seq").alias("first_id"),
        *[F.first(c).alias(c) for c in (*named, "page", "parent")])
    kind = rows.schema["league_id"].dataType.simpleString()
    answer = walk_sorted(distinct, ["block", "fixed"], ["seq", "value"], GroupWalk,
                         f"block string, fixed string, value string, group_id {kind}, solo boolean")
    members = rows.select("league_id", "block", "fixed", "value").join(answer, ["block", "fixed", "value"])
    alone = F.col("solo") & (F.col("league_id") != F.col("group_id"))
    return members.select("league_id", F.when(alone, F.col("league_id")).otherwise(F.col("group_id")).alias("group_id"))


def deduplicate(df: DataFrame, parent_map: DataFrame | None = None, **options) -> DataFrame:
    """One merged record per group of the batch."""
    grouped = df.join(assign_groups(df, parent_map=parent_map, **options), "league_id")
    return merge_groups(grouped, ["group_id"], options.get("sequence", "league_id"))
