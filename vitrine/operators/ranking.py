"""Row numbers and pages over groups of any size: no group is ever brought together in one task."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import constants as K
from vitrine.functions import text as T
from vitrine.sources import files


def _kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = files.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the row's number within ``by``, from 1, in ascending ``order``, which must be total.

    Rows are dealt by ranges of both, so a large group lies over many tasks; a number is the row's place in its task plus
    what the group has in the tasks before. The result is written; ``rows`` should be cheap to read twice, as ranges are
    found by a sample."""
    d = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    d = _kept(d.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33)), "ordered")
    # one row for each group and task that holds a part of it
    parts = d.groupBy(*by, "_p").agg(F.min("_m").alias("_lo"), F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*by, "_p"])], "_lo", "_before")
    both = d.join(parts, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate([*by, "_p"])])
    return _kept(both.select(*rows.columns, (F.col("_m") - F.col("_lo") + F.col("_before") + 1).alias(out)), "numbered")


def descending(score: Column | str) -> Column:
    """A column whose ascending order is that of ``score`` from the greatest on; null and NaN come last."""
    s = F.col(score) if isinstance(score, str) else score
    return F.coalesce(F.nanvl(-s, F.lit(float("inf"))), F.lit(float("inf")))


class _Pages:
    """The pages of one query as far as they went: what stands on the page at hand, and the heads of each brand's queue."""

    def __init__(self, done: int, out: int, page_no: int, due: bool, per_brand: int, page: int):
        self.done, self.out, self.page_no, self.due = done, out, page_no, due
        self.per_brand, self.page = per_brand, page
        self.used: dict[str, int] = {}
        self.placed: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.heads: dict[str, deque[int]] = {}
        self.found: list[tuple[int, int]] = []

    def more(self, brand: str) -> bool:
        """Whether more of the brand wait than its heads show."""
        return self.seen.get(brand, 0) - self.placed.get(brand, 0) > len(self.heads.get(brand, ()))

    def put(self, n: int, brand: str) -> None:
        self.found.append((n, self.out))
        self.out += 1
        self.used[brand] = self.used.get(brand, 0) + 1
        self.placed[brand] = self.placed.get(brand, 0) + 1

    def turned(self) -> bool:
        """Begin the next page with what waits, a brand's share each; false if a queue's heads don't reach for that."""
        if not self.due:
            return True
        if any(len(h) < self.per_brand and self.more(b) for b, h in self.heads.items()):
            return False
        self.due, self.page_no, self.used = False, self.out // self.page, {}
        first = sorted((n, b) for b, h in self.heads.items() for n in list(h)[: self.per_brand])
        for n, b in first:
            self.heads[b].popleft()
            self.put(n, b)
        return True

    def take(self, n: int, brand: str) -> None:
        """The next row: on the page, or at the end of its brand's queue."""
        queue_full = self.more(brand)
        self.seen[brand] = self.seen.get(brand, 0) + 1
        if self.used.get(brand, 0) < self.per_brand:
            self.put(n, brand)
        elif not queue_full:
            self.heads.setdefault(brand, deque()).append(n)
        self.done = n
        self.due = self.out > 0 and self.out % self.page == 0 and self.out // self.page != self.page_no


def all_pages(found: DataFrame, per_brand: int = K.PER_BRAND, page: int = K.PAGE, slice_rows: int = 50_000, heads: int = 64) -> DataFrame:
    """Every page of each query: rows (``query_id, id, brand, title, score``) get ``position``, from 0.

    Of each brand and colourway the best row shows. A brand has ``per_brand`` rows on a page; further ones wait in the
    brand's queue, each new page begins with the heads of the queues in their order, and what waits in the end follows.
    Which row comes next depends on those before, so each round takes the next ``slice_rows`` rows of a query, and of each
    queue its first ``heads``; places, page and queues go on to the next round as tables. A queue is told by two numbers, as a
    brand's rows show in their order. Neither size changes the result. A null query or brand is a value like any other,
    null and NaN scores come last; repeated rows show once; an empty table gives no rows."""
    kinds = dict(found.dtypes)
    rows = found.select("query_id", "id", F.coalesce(F.col("brand").cast("string"), F.lit("\0")).alias("brand"), F.col("score").cast("double").alias("score"), T.colourway("title").alias("way"))
    best = rows.groupBy("query_id", "brand", "way").agg(F.min(F.struct(descending("score").alias("o"), "id", "score")).alias("b"))
    best = _kept(best.select("query_id", "brand", "b.id", "b.score", "b.o"), "shown")
    t = numbered(numbered(best, ["query_id"], ["o", "id"], "n").drop("o"), ["query_id", "brand"], ["n"], "m")
    # one row for each query: rows gone through, rows placed, page, whether a new page is due; and one for each of its brands
    state = t.groupBy("query_id").agg(F.max("n").alias("total")).select("query_id", "total", F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("out"), F.lit(0).cast("long").alias("page_no"), F.lit(0).cast("long").alias("due"))
    narrow = f"query_id {kinds['query_id']}, kind int, brand string, a long, b long, c long, d long, e long"
    brands = t.select("query_id", "brand", F.lit(0).cast("long").alias("placed"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("used")).limit(0)

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {k: g for k, g in pdf.groupby("kind")}
        s = parts[0].iloc[0]
        p = _Pages(int(s["b"]), int(s["c"]), int(s["d"]), bool(s["e"]), per_brand, page)
        for b, placed, seen, used in parts[1][["brand", "a", "b", "c"]].itertuples(index=False) if 1 in parts else ():
            p.placed[b], p.seen[b] = placed, seen
            if used:
                p.used[b] = used
        for n, b in sorted(parts[2][["a", "brand"]].itertuples(index=False, name=None)) if 2 in parts else ():
            p.heads.setdefault(b, deque()).append(n)
        ahead = sorted(parts[3][["a", "brand"]].itertuples(index=False, name=None)) if 3 in parts else []
        if p.turned():
            for n, b in ahead:
                p.take(n, b)
                if not p.turned():
                    break
        out = [(0, "", s["a"], p.done, p.out, p.page_no, int(p.due))]
        out += [(1, b, p.placed.get(b, 0), k, p.used.get(b, 0), 0, 0) for b, k in p.seen.items()]
        out += [(2, "", n, at, 0, 0, 0) for n, at in p.found]
        return pd.DataFrame(out, columns=["kind", "brand", "a", "b", "c", "d", "e"]).assign(query_id=[s["query_id"]] * len(out))[["query_id", "kind", "brand", "a", "b", "c", "d", "e"]]

    def as_rows(df: DataFrame, kind: int, *cols: str) -> DataFrame:
        values = [F.col(c) for c in cols] + [F.lit(0)] * (5 - len(cols))
        brand = F.col("brand") if "brand" in df.columns else F.lit("")
        return df.select("query_id", F.lit(kind).alias("kind"), brand.alias("brand"), *[v.cast("long").alias(n) for v, n in zip(values, "abcde")])

    def of(df: DataFrame, other: DataFrame, *on: str) -> DataFrame:
        """Joined, nulls equal."""
        renamed = other.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in other.columns])
        return df.join(renamed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]).drop(*[f"_{c}" for c in on])

    places, ended, ended_brands = None, None, None
    while True:
        ahead = of(t, state.select("query_id", "done"), "query_id").where((F.col("n") > F.col("done")) & (F.col("n") <= F.col("done") + slice_rows))
        queue = of(t, brands.where("seen > placed"), "query_id", "brand").where("m > placed AND m <= seen").where(F.col("m") <= F.col("placed") + heads)
        both = as_rows(state, 0, "total", "done", "out", "page_no", "due").unionByName(as_rows(brands, 1, "placed", "seen", "used"))
        both = both.unionByName(as_rows(queue, 2, "n")).unionByName(as_rows(ahead, 3, "n"))
        got = _kept(both.groupBy("query_id").applyInPandas(step, narrow), "pages")
        new = got.where("kind = 2").select("query_id", F.col("a").alias("n"), F.col("b").alias("position"))
        places = new if places is None else places.unionByName(new)
        state = got.where("kind = 0").select("query_id", F.col("a").alias("total"), F.col("b").alias("done"), F.col("c").alias("out"), F.col("d").alias("page_no"), F.col("e").alias("due"))
        brands = got.where("kind = 1").select("query_id", "brand", F.col("a").alias("placed"), F.col("b").alias("seen"), F.col("c").alias("used"))
        over = state.where("done >= total AND due = 0")
        ended = over if ended is None else ended.unionByName(over)
        mine = of(brands, over.select("query_id"), "query_id")
        ended_brands = mine if ended_brands is None else ended_brands.unionByName(mine)
        state = state.where("done < total OR due = 1")
        if state.isEmpty():
            break
        brands = of(brands, state.select("query_id"), "query_id")
    waiting = _kept(of(t, ended_brands.select("query_id", "brand", "placed"), "query_id", "brand").where("m > placed").select("query_id", "n"), "waiting")
    last = of(numbered(waiting, ["query_id"], ["n"], "r"), ended.select("query_id", "out"), "query_id").select("query_id", "n", (F.col("out") + F.col("r") - 1).alias("position"))
    shown = of(t, places.unionByName(last), "query_id", "n")
    return shown.select("query_id", "id", F.nullif("brand", F.lit("\0")).cast(kinds["brand"]).alias("brand"), "score", F.col("position").cast("long").alias("position"))
