"""Fuzzy queries over a string column: verdicts as native predicates, scores and ranks by Arrow batches.

A query is terms separated by spaces, all of which must hold; ``|`` between terms joins them as alternatives;
``'x`` is exact, ``'x'`` exact between word boundaries, ``^x`` a prefix, ``x$`` a suffix, ``^x$`` the whole item,
``!x`` excludes; a backslash keeps a space.  A term without capitals ignores case, one without marked Latin letters
ignores such marks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alignment, fields, runes
from ..functions.alignment import TOP
from ..functions.arrays import let
from . import fits


@dataclass(frozen=True)
class Term:
    kind: str  # fuzzy, exact, boundary, prefix, suffix or equal
    text: str
    inverse: bool
    sensitive: bool
    plain: bool = False

    def holds(self, item: Column) -> Column:
        item = item if self.sensitive else F.lower(item)
        if self.plain:
            item = F.translate(item, "".join(runes.plain_letters()), "".join(runes.plain_letters().values()))
        if self.kind == "fuzzy":
            quoted = [f"\\{c}" if c in "%_\\" else c for c in self.text]
            hit = item.like("%" + "%".join(quoted) + "%")
        elif self.kind == "exact":
            hit = item.contains(self.text)
        elif self.kind == "boundary":
            quoted = "".join(f"\\x{{{ord(c):x}}}" for c in self.text)
            hit = item.rlike(rf"(?<![\p{{L}}\p{{N}}]){quoted}(?![\p{{L}}\p{{N}}])")
        elif self.kind == "prefix":
            hit = (item if self.text[:1].isspace() else F.regexp_replace(item, r"(?U)\A\s+", "")).startswith(self.text)
        elif self.kind == "suffix":
            hit = (item if self.text[-1:].isspace() else F.regexp_replace(item, r"(?U)\s+\z", "")).endswith(self.text)
        else:
            hit = F.regexp_replace(item, r"(?U)\A\s+|\s+\z", "") == self.text
        return ~hit if self.inverse else hit


def parse(query: str, case: str = "smart", exact: bool = False, extended: bool = True, normalize: bool = True) -> list[list[Term]]:
    """Sets of alternative terms, all of which must hold."""

    def term(text: str, plain: bool = False) -> Term | None:
        low = runes.lower_text(text)
        sensitive = case == "respect" or case == "smart" and text != low
        plain_marks = normalize and runes.plain_text(low) == low
        text = text if sensitive else low
        kind, inverse = ("exact" if exact else "fuzzy"), False
        if not plain:
            if text.startswith("!"):
                inverse, kind, text = True, "exact", text[1:]
            if text != "$" and text.endswith("$"):
                kind, text = "suffix", text[:-1]
            if len(text) > 2 and text.startswith("'") and text.endswith("'"):
                kind, text = "boundary", text[1:-1]
            elif text.startswith("'"):
                kind, text = ("exact" if not exact and not inverse else "fuzzy"), text[1:]
            elif text.startswith("^"):
                kind, text = ("equal" if kind == "suffix" else "prefix"), text[1:]
            text = runes.plain_text(text) if plain_marks else text
        return Term(kind, text, inverse, sensitive, plain_marks) if text else None

    if not extended:
        return [[t]] if (t := term(query, plain=True)) else []
    query = query.lstrip(" ")
    query = query.rstrip(" ") + " " * query.rstrip(" ").endswith("\\")
    sets: list[list[Term]] = []
    join = may_join = False
    for token in query.replace("\\ ", "\t").split(" "):
        if not token:
            continue
        if token == "|" and may_join:
            join, may_join = True, False
            continue
        if t := term(token.replace("\t", " ")):
            if join and sets:
                sets[-1].append(t)
            else:
                sets.append([t])
            may_join = True
        join = False
    return sets


def fuzzy_filter(df: DataFrame, item_col: str, query: str, **options) -> DataFrame:
    """The rows whose item matches; rows keep their order column, ranking is fuzzy_rank's."""
    for terms in parse(query, **options):
        hit = F.lit(False)
        for t in terms:
            hit = hit | t.holds(F.col(item_col))
        df = df.where(hit)
    return df


def likely(df: DataFrame, item_col: str, sets: list[list[Term]]) -> DataFrame:
    """Drops rows that native predicates rule out; characters beyond ASCII fold differently there, so such terms wait."""
    for terms in sets:
        if all(t.text.isascii() for t in terms):
            hit = F.lit(False)
            for t in terms:
                hit = hit | t.holds(F.col(item_col))
            df = df.where(hit)
    return df


@dataclass(frozen=True)
class Ranking:
    """How matches are scored and ordered: a scheme (default, path, history) and up to three tiebreaks.

    nth limits the search to fields between delimiters: 2, -1, 2.., ..-2 or a list of such.
    """

    scheme: str = "default"
    tiebreak: tuple[str, ...] | None = None
    greedy: bool = False
    nth: str | None = None
    delimiter: str | None = None

    def order(self) -> tuple[str, ...]:
        given = alignment.TIEBREAKS[self.scheme] if self.tiebreak is None else self.tiebreak
        return tuple(t for t in given if t != "index")[:3]

    def forward(self) -> bool:
        return next((t in ("begin",) for t in self.order() if t in ("begin", "end", "pathname")), True)

    def run(self, items: list[str], sets: list[list[Term]], places: bool = False) -> Iterator:
        by_place = bool({"chunk", "pathname"} & set(self.order()))
        return alignment.evaluate(items, sets, self.scheme, self.order(), self.forward(), by_place, self.greedy, places, fields.splitter(self.nth, self.delimiter) if self.nth else None)


RANKS = ["rank3", "rank2", "rank1", "rank0"]


def scored(df: DataFrame, item_col: str, sets: list[list[Term]], ranking: Ranking) -> DataFrame:
    """Matching rows with their score and the four rank values (smaller first).

    Each term's fit is a column: native, but for the alignment of fuzzy terms.  What the terms of a set and the sets make
    of them, and the rank values, are native.
    """
    rows = df.where(F.col(item_col).isNotNull())
    kept = [c for c in df.columns if c not in ("score", *RANKS)]
    if ranking.nth:
        return scored_in_fields(rows, item_col, kept, sets, ranking)
    item, order = F.col(item_col), ranking.order()
    by_place = bool({"chunk", "pathname"} & set(order))
    rows = likely(rows, item_col, sets).select(*kept)
    names: list[list[str]] = []
    for k, terms in enumerate(sets):
        names.append([f"_fit{k}_{n}" for n in range(len(terms))])
        rows = rows.withColumns({name: fits.fit_of(item, t, ranking.scheme, ranking.forward(), ranking.greedy, by_place) for name, t in zip(names[-1], terms)})
    every = F.array(*(fits.of_set(terms, [F.col(n) for n in own]) for terms, own in zip(sets, names))) if sets else F.array().cast("array<struct<hit:boolean,start:int,end:int,score:int>>")
    if sets:
        rows = rows.where(reduce(lambda a, b: a & b, [fits.of_set(terms, [F.col(n) for n in own])["hit"] for terms, own in zip(sets, names)]))

    def told(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0), lambda a, f: a + f["score"])
        wide = F.filter(found, lambda f: f["start"] < f["end"])
        first = (F.lit(TOP) - F.least(F.greatest(total, F.lit(0)), F.lit(TOP))).cast("int")
        ties = [let(wide, partial(fits.rank, item, c)) for c in order]
        ranks = [first, *ties, *[F.lit(0)] * (3 - len(ties))]
        return F.struct(total.alias("score"), *(r.alias(n) for r, n in zip(ranks, RANKS)))

    rows = rows.select(*kept, let(every, told).alias("_fit"))
    return rows.select(*kept, *[F.col(f"_fit.{c}").alias(c) for c in ("score", *RANKS)])


def scored_in_fields(rows: DataFrame, item_col: str, kept: list[str], sets: list[list[Term]], ranking: Ranking) -> DataFrame:
    """The same for terms that are looked for in some fields of an item, one after the other."""

    @F.pandas_udf("hit boolean, score int, rank3 int, rank2 int, rank1 int, rank0 int")
    def fit(item: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame(0, index=range(len(item)), columns=["hit", "score", *RANKS])
        out["hit"] = False
        for index, hit, score, ranks, _ in ranking.run(list(item), sets):
            out.loc[index, "hit"], out.loc[index, "score"], out.loc[index, RANKS] = hit, score, ranks
        return out

    # Not told to be deterministic, lest the filter gets an evaluation of its own.
    fitted = rows.select(*kept, fit.asNondeterministic()(item_col).alias("_fit")).where("_fit.hit")
    return fitted.select(*kept, *[F.col(f"_fit.{c}").alias(c) for c in ("score", *RANKS)])


def fuzzy_rank(df: DataFrame, item_col: str | Column, query: str, index_col: str, limit: int | None = None, ranking: Ranking = Ranking(), sort: bool = True, tac: bool = False, positions: bool = False, **options) -> DataFrame:
    """Matching rows, best first, with score and rank values, and matched byte offsets where asked for.

    item_col is a column's name or any expression.  Ties, and all rows of a query without sorting or without a positive term,
    go by the index column (tac: from the last).  A null item never matches; an empty query keeps all items.  Columns score
    and rank0 to rank3 replace columns of these names.
    """
    sets = parse(query, **options)
    rows = df.withColumn("_rank_item", F.col(item_col) if isinstance(item_col, str) else item_col).withColumn("_rank_index", F.col(index_col))
    by_index = F.col("_rank_index").desc() if tac else F.col("_rank_index").asc()
    rows = scored(rows, "_rank_item", sets, ranking)
    positive = not options.get("extended", True) or any(not t.inverse for terms in sets for t in terms)
    rows = rows.orderBy(*(RANKS if sort and sets and positive else []), by_index)
    if limit is not None:
        rows = rows.limit(limit)
    if positions:
        rows = with_positions(rows, "_rank_item", sets, ranking)
    return rows.drop("_rank_item", "_rank_index")


def char_indices(item: Column, positions: Column) -> Column:
    """Byte offsets within an item as numbers of characters; an offset within a character goes with the next."""
    data = F.encode(item, "UTF-8")
    starts = lambda p: F.length(F.regexp_replace(F.hex(F.substring(data, F.lit(1), p)), "[89AB].|(..)", "$1"))
    return F.transform(positions, lambda p: (starts(p) / 2).cast("int"))


def display(item: Column, positions: Column) -> Column:
    """struct<text, positions>: strings hold no bytes that can't be read, so an item is shown as it is."""
    return F.struct(item.alias("text"), positions.alias("positions"))


def printed(ranked: DataFrame, item_col: str, debug: bool = False) -> DataFrame:
    """Ranked rows as text lines, in their order: the item; with debug its score and positions before it."""
    line = F.col(item_col)
    if debug:
        places = F.concat(F.lit("["), F.array_join(F.col("positions").cast("array<string>"), ","), F.lit("]"))
        line = F.concat_ws("\t", F.col("score").cast("string"), places, line)
    return ranked.select(line.alias("value"))


def with_positions(df: DataFrame, item_col: str, sets: list[list[Term]], ranking: Ranking) -> DataFrame:
    """Adds the byte offsets of matched characters; meant for the rows that a limit kept."""

    @F.pandas_udf("array<int>")
    def offsets(item: pd.Series) -> pd.Series:
        items, out = list(item), [[] for _ in item]
        for index, hit, _, _, places in ranking.run(items, sets, places=True):
            for i, ok, columns in zip(index, hit, places):
                if ok and items[i].isascii():
                    out[i] = columns.tolist()
                elif ok:
                    starts = [0]
                    for c in items[i]:
                        starts.append(starts[-1] + len(c.encode()))
                    out[i] = [starts[c] for c in columns]
        return pd.Series(out)

    # Not told to be deterministic, lest it moves below the limit and a full sort replaces the top-k.
    return df.withColumn("positions", offsets.asNondeterministic()(item_col))
