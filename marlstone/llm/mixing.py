"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked until each
dimension's shares meet its target; documents are then sampled by the
calibrated probability of their cell, raked once more with the bound of 1, so
that the sample meets the targets too. A category that has too few tokens for
its share of the sample is taken whole and reported. DataFrame expressions only.

Defined cases: a null in a dimension is a cell of its own; a null or empty
text has no tokens, and its cell's probability holds for it too; a category
without a target keeps its own share; a target without documents is left out
and the rest scaled to 1; the draw is a hash of seed, doc_id and text, so
repeated rows share one fate; an empty table gives no rows; extra columns stay,
and a column with the name of an added one is replaced.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, written

DIMENSIONS = ("source", "lang", "topic")
#: Shares of the sample's tokens that the registered query and the pipeline ask for; sources have none and are tempered.
TARGETS = {
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    "topic": {"long": 0.3, "medium": 0.53, "short": 0.03, "table": 0.06, "symbols": 0.06, "shouting": 0.02},
}
#: Without explicit targets a share s becomes s ** TEMPER, normalised: small sources gain, large ones lose.
TEMPER = 0.8
#: Share of all tokens that the sample is to hold.
KEEP = 0.6
TOLERANCE = 1e-6
MAX_ROUNDS = 50
#: Up to so many cells are raked as arrays in one row, all rounds in one job; more are raked as rows, a few jobs for each round.
ROW_CELLS, ROW_ROUNDS = 5_000, 400
#: A margin of the expected sample that is further from its target than this share of the sample is reported.
SLACK = 1e-4
#: Cells that are sent to all executors for the last join; more are joined by a shuffle.
BROADCAST_CELLS = 20_000
SEED = 17


def tokens(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def topic(text: Column) -> Column:
    """A coarse topic from the form of the text alone."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.contains(" | "), "table").when(t.contains("###") | t.contains("$$$"), "symbols").when(t.contains("!!"), "shouting")
        .when(F.char_length(t) < 600, "short").when(F.char_length(t) < 6000, "medium").otherwise("long")
    )


def goals(cells: DataFrame, dim: str, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """(key, goal): the share of all tokens that each category of a dimension is to have; shares sum to 1."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    own = cells.groupBy(dim).agg((F.sum("tokens") / F.lit(float(max(total, 1)))).alias("share"))
    wanted = (targets or {}).get(dim)
    if wanted:
        pairs = F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(float(v)))])
        own = own.withColumn("goal", F.coalesce(F.try_element_at(pairs, F.col(dim)), F.col("share")))
    else:
        own = own.withColumn("goal", F.when(F.col("share") > 0, F.pow("share", F.lit(temper))).otherwise(0.0))
    whole = own.agg(F.sum(F.when(F.col("share") > 0, F.col("goal")))).first()[0] or 1.0
    return own.select(F.col(dim).alias("key"), (F.col("goal") / whole).alias("goal"))


def _field(name: str):
    return lambda c: c[name]


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


class _Row:
    """The cells as arrays of one row, and raking as expressions over them.

    A cell gives own * min(1, product of its categories' factors), or without
    the bound own * product. A step sets one dimension's factors: the cells at
    their bound are taken as they are, and the others raked to what is left.
    """

    def __init__(self, cells: DataFrame, targets: dict[str, dict[str, float]] | None, temper: float):
        self.dims = [c for c in cells.columns if c not in ("tokens", "raked")]
        spans = range(len(self.dims))
        row = cells.select(F.struct(*self.dims, F.col("tokens").cast("double").alias("own")).alias("c")).agg(F.array_sort(F.collect_list("c")).alias("cells"))
        keys = {f"keys_{k}": F.array_sort(F.array_distinct(F.transform("cells", _field(d)))) for k, d in enumerate(self.dims)}
        row = cut(row.withColumns(keys))
        place = lambda c: [(F.array_position(F.col(f"keys_{k}"), c[d]) - 1).cast("int").alias(f"i{k}") for k, d in enumerate(self.dims)]
        row = cut(row.withColumn("nums", F.transform("cells", lambda c: F.struct(c["own"].alias("own"), *place(c)))))
        members = {f"members_{k}": F.transform(F.col(f"keys_{k}"), self._members(k)) for k in spans}
        row = cut(row.withColumns(members).withColumn("total", F.aggregate("nums", F.lit(0.0), lambda acc, c: acc + c["own"])))
        own = {f"own_{k}": F.transform(F.col(f"members_{k}"), lambda m: F.aggregate(m, F.lit(0.0), lambda acc, c: acc + c["own"])) for k in spans}
        row = row.withColumns(own)
        for k, d in enumerate(self.dims):
            row = row.withColumn(f"want_{k}", self._wanted(k, (targets or {}).get(d), temper))
        self.row = cut(row)

    def _members(self, k: int):
        def of(_: Column, j: Column) -> Column:
            return F.filter("nums", lambda c: c[f"i{k}"] == j)

        return of

    def _wanted(self, k: int, target: dict[str, float] | None, temper: float) -> Column:
        """Each category's share of the tokens; shares sum to 1."""
        share = F.transform(F.col(f"own_{k}"), lambda x: x / F.greatest(F.col("total"), F.lit(1.0)))
        if target:
            pairs = F.create_map(*[x for key, v in target.items() for x in (F.lit(key), F.lit(float(v)))])
            raw = F.zip_with(F.col(f"keys_{k}"), share, lambda key, s: F.when(s > 0, F.coalesce(F.try_element_at(pairs, key), s)).otherwise(F.lit(0.0)))
        else:
            raw = F.transform(share, lambda s: F.when(s > 0, F.pow(s, F.lit(temper))).otherwise(F.lit(0.0)))
        return _let(raw, lambda r: _let(F.aggregate(r, F.lit(0.0), lambda acc, x: acc + x), lambda whole: F.transform(r, lambda x: F.when(whole > 0, x / whole).otherwise(F.lit(0.0)))))

    def _goal(self, k: int, keep: float | None) -> Column:
        """Tokens that each category is to give: its share of all, or of the part that is kept, but not more than it has."""
        want = F.col(f"want_{k}")
        if keep is None:
            return F.transform(want, lambda w: w * F.col("total"))
        pair = F.arrays_zip(F.col(f"own_{k}").alias("own"), want.alias("want"))

        def level(c: Column, _: Column) -> Column:
            full = lambda x: c * x["want"] >= x["own"]
            both = F.aggregate(pair, F.struct(F.lit(0.0).alias("own"), F.lit(0.0).alias("want")), lambda acc, x: F.struct((acc["own"] + F.when(full(x), x["own"]).otherwise(0.0)).alias("own"), (acc["want"] + F.when(full(x), 0.0).otherwise(x["want"])).alias("want")))
            return _let(both, lambda b: F.when(b["want"] > 0, (keep * F.col("total") - b["own"]) / b["want"]).otherwise(c))

        c = F.aggregate(F.sequence(F.lit(0), F.size(want)), keep * F.col("total"), level)
        return _let(c, lambda c: F.zip_with(F.col(f"own_{k}"), want, lambda o, w: F.least(o, c * w)))

    def factors(self, keep: float | None) -> DataFrame:
        """The row with f, a struct of factors by dimension, and off, the furthest margin; keep: with the bound, for so much of the tokens."""
        spans = range(len(self.dims))
        row = cut(self.row.withColumns({f"goal_{k}": self._goal(k, keep) for k in spans}))
        tolerance = TOLERANCE * F.greatest(F.col("total"), F.lit(1.0))

        def given(a: Column, k: int, m: Column, f: Column) -> Column:
            """Of a category with factor f: tokens of cells at their bound, the others' for a factor of 1, and the factor that has all at their bound."""

            def add(acc: Column, c: Column) -> Column:
                rest = F.lit(1.0)
                for d in spans:
                    if d != k:
                        rest = rest * F.get(a[f"f{d}"], c[f"i{d}"])
                full = f * rest >= 1.0 if keep is not None else F.lit(False)
                return F.struct((acc["full"] + F.when(full, c["own"]).otherwise(0.0)).alias("full"), (acc["free"] + F.when(full, 0.0).otherwise(c["own"] * rest)).alias("free"), F.greatest(acc["top"], F.when(rest > 0, 1.0 / rest).otherwise(0.0)).alias("top"))

            return F.aggregate(m, F.struct(*[F.lit(0.0).alias(x) for x in ("full", "free", "top")]), add)

        def move(k: int):
            def update(a: Column) -> Column:
                def new(m: Column, j: Column) -> Column:
                    f, goal = F.get(a[f"f{k}"], j), F.get(F.col(f"goal_{k}"), j)
                    all_of_it = F.lit(keep is not None) & (goal >= F.get(F.col(f"own_{k}"), j) * (1 - 1e-9))
                    root = lambda g: F.when(all_of_it, F.least(2 * F.greatest(f, g["top"]), F.lit(1e12))).when(g["free"] <= 0, f).when(goal > g["full"], (goal - g["full"]) / g["free"]).otherwise(f * goal / (g["full"] + f * g["free"]))
                    return _let(given(a, k, m, f), root)

                return F.struct(*[(F.transform(F.col(f"members_{k}"), new) if d == k else a[f"f{d}"]).alias(f"f{d}") for d in spans], a["off"].alias("off"))

            return update

        def miss(a: Column, k: int):
            def of(m: Column, j: Column) -> Column:
                f = F.get(a[f"f{k}"], j)
                return _let(given(a, k, m, f), lambda g: F.abs(g["full"] + f * g["free"] - F.get(F.col(f"goal_{k}"), j)))

            return of

        def measured(a: Column) -> Column:
            off = F.lit(0.0)
            for k in spans:

                off = F.greatest(off, F.array_max(F.transform(F.col(f"members_{k}"), miss(a, k))))
            return F.struct(*[a[f"f{d}"].alias(f"f{d}") for d in spans], off.alias("off"))

        def step(acc: Column, _: Column) -> Column:
            out = acc
            for k in spans:
                out = _let(out, move(k))
            return F.when(acc["off"] <= tolerance, acc).otherwise(_let(out, measured))

        ones = [F.transform(F.col(f"keys_{k}"), lambda _: F.lit(1.0 if keep is None or k else keep)).alias(f"f{k}") for k in spans]  # noqa: B023
        start = F.struct(*ones, F.lit(float("inf")).alias("off"))
        return cut(row.withColumn("f", F.aggregate(F.sequence(F.lit(1), F.lit(ROW_ROUNDS)), start, step)))

    def cells(self, row: DataFrame, keep: float | None) -> DataFrame:
        """A row per cell: its dimensions, own, and the share of its tokens that it gives."""
        share = F.lit(1.0)
        for k in range(len(self.dims)):
            share = share * F.get(F.col(f"f.f{k}"), F.col(f"n.i{k}"))
        pairs = row.select("f", F.explode(F.arrays_zip(F.col("cells"), F.col("nums"))).alias("x")).select("f", F.col("x.cells").alias("c"), F.col("x.nums").alias("n"))
        return pairs.select(*[F.col(f"c.{d}").alias(d) for d in self.dims], F.col("c.own").alias("own"), (share if keep is None else F.least(share, F.lit(1.0))).alias("share"))


def _warn(off: float, total: float, rounds: int) -> None:
    if off > TOLERANCE * max(total, 1):
        warnings.warn(f"raking ended after {rounds} rounds with a margin off by {off / max(total, 1):.2g} of all tokens", stacklevel=3)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """cells (the dimensions and tokens) with raked: token weights that meet the targets, their total unchanged.

    Cells are one row for each combination that occurs, not for each document.
    Each round divides by the running margins of one dimension after another;
    rounds end when no margin is off by more than TOLERANCE, with a warning if
    MAX_ROUNDS come first.
    """
    cells = cut(cells)
    if 0 < cells.count() <= ROW_CELLS:
        small = _Row(cells, targets, temper)
        row = small.factors(None)
        _warn(*row.select("f.off", "total").first(), ROW_ROUNDS)
        found = small.cells(row, None)
        return cut(found.select(*small.dims, F.col("own").cast("bigint").alias("tokens"), (F.col("own") * F.col("share")).alias("raked")))
    dims = [c for c in cells.columns if c != "tokens"]
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    state = cells.withColumn("raked", F.col("tokens").cast("double"))
    wanted = {d: goals(cells, d, targets, temper).withColumn("goal", F.col("goal") * float(total)) for d in dims}
    state = written(state)
    off = 0.0
    for _ in range(MAX_ROUNDS):
        for d in dims:
            margin = state.groupBy(F.col(d).alias("key")).agg(F.sum("raked").alias("margin")).join(wanted[d], "key")
            factor = margin.select("key", F.when(F.col("margin") > 0, F.col("goal") / F.col("margin")).otherwise(0.0).alias("factor"))
            state = state.join(factor, state[d] == factor["key"]).withColumn("raked", F.col("raked") * F.col("factor")).drop("key", "factor")
        state = written(state)
        off = 0.0
        for d in dims[:-1]:  # the last has just been met
            margin = state.groupBy(F.col(d).alias("key")).agg(F.sum("raked").alias("margin")).join(wanted[d], "key")
            off = max(off, margin.agg(F.max(F.abs(F.col("margin") - F.col("goal")))).first()[0] or 0.0)
        if off <= TOLERANCE * max(total, 1):
            break
    else:
        warnings.warn(f"raking ended after {MAX_ROUNDS} rounds with a margin off by {off / max(total, 1):.2g} of all tokens", stacklevel=2)
    return state


def reachable(wanted: DataFrame, cells: DataFrame, dim: str, keep: float, total: float) -> DataFrame:
    """(key, goal in tokens): keep * total dealt by the shares of wanted, but no category gets more than it has.

    What a category lacks goes to the others in proportion to their goals: goal = min(own tokens, c * share).
    """
    own = cells.groupBy(F.col(dim).alias("key")).agg(F.sum("tokens").cast("double").alias("own")).join(wanted, "key")
    order = Window.orderBy(F.when(F.col("goal") > 0, F.col("own") / F.col("goal")).otherwise(float("inf")), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = own.withColumn("c", (F.lit(keep * total) - F.coalesce(F.sum("own").over(before), F.lit(0.0))) / F.nullif(F.sum("goal").over(after), F.lit(0.0)))
    c = level.agg(F.max("c")).first()[0] or 0.0
    return own.select("key", F.least("own", F.col("goal") * c).alias("goal"))


def calibrate(cells: DataFrame, keep: float, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """cells with probability, 1 at most, such that the expected sample holds `keep` of the tokens and meets the targets.

    The bound is part of the raking: a cell is expected to give min(tokens,
    its factors * raked), and each round finds, for one dimension after
    another, the factor of every category with which its cells give its goal.
    A category that has less than its goal is taken whole and the rest of its
    dimension shares what it lacks; such margins, and those that are still
    off after MAX_ROUNDS, are named in a warning (margins() gives all).
    """
    cells = cut(cells)
    dims = [c for c in cells.columns if c not in ("tokens", "raked")]
    if 0 < cells.count() <= ROW_CELLS:
        return _calibrate_row(cells, dims, keep, targets, temper)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    asked = {d: cut(goals(cells, d, targets, temper)) for d in dims}
    state = cells.withColumn("own", F.col("tokens").cast("double")).withColumn("free", F.col("raked") * keep)
    for k, d in enumerate(dims):
        goal = reachable(asked[d], cells, d, keep, total).select(F.col("key").alias(f"key_{k}"), F.col("goal").alias(f"goal_{k}"))
        state = state.join(goal, F.col(d) == F.col(f"key_{k}")).drop(f"key_{k}")
    state = written(state)
    given = F.least("own", "free")
    for _ in range(MAX_ROUNDS):
        pairs = [F.struct(F.lit(k).alias("dim"), F.col(d).alias("key"), F.col(f"goal_{k}").alias("goal")) for k, d in enumerate(dims)]
        margin = state.select(F.explode(F.array(*pairs)).alias("m"), given.alias("given")).groupBy("m").agg(F.sum("given").alias("given"))
        off = margin.agg(F.max(F.abs(F.col("given") - F.col("m.goal")))).first()[0] or 0.0
        if off <= TOLERANCE * max(total, 1):
            break
        for k, d in enumerate(dims):
            # sum(min(own, f * free)) is the least of the lines that hold the first cells at their bound, so f is the greatest of their roots
            whole = Window.partitionBy(d)
            order = whole.orderBy("ratio", *[x for x in dims if x != d])
            before = F.coalesce(F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            after = F.sum("free").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
            state = state.withColumn("ratio", F.when(F.col("free") > 0, F.col("own") / F.col("free")).otherwise(float("inf")))
            state = state.withColumn("root", (F.col(f"goal_{k}") - before) / F.nullif(after, F.lit(0.0)))
            top = F.max(F.when(F.col("free") > 0, F.col("ratio"))).over(whole)
            full = F.col(f"goal_{k}") >= F.sum("own").over(whole) * (1 - 1e-9)
            factor = F.when(full, F.greatest(top, F.lit(1.0))).otherwise(F.greatest(F.max("root").over(whole), F.lit(0.0)))
            state = state.withColumn("factor", F.coalesce(factor, F.lit(1.0)))
            # a cell far beyond its bound stays there
            state = state.withColumn("free", F.least(F.col("free") * F.col("factor"), F.col("own") * 1e12)).drop("ratio", "root", "factor")
        state = written(state)
    state = state.withColumn("probability", F.when(F.col("own") > 0, given / F.col("own")).otherwise(F.lit(1.0)))
    missed = [x for d in dims for x in _shares(state.withColumn("expected", given), asked[d], d, ["expected"]).filter(F.abs(F.col("expected") - F.col("target")) > SLACK).orderBy(F.desc(F.abs(F.col("expected") - F.col("target")))).limit(10).collect()]
    _report([(x.dimension, x.category, x.expected, x.target) for x in missed], keep)
    return state.select(*cells.columns, "probability")


def _report(missed: list[tuple[str, str, float, float]], keep: float) -> None:
    if missed:
        named = ", ".join(f"{d.removeprefix('cell_')} {c!r} {got:.4f} for {target:.4f}" for d, c, got, target in missed)
        warnings.warn(f"margins that cannot be met with {keep} of the tokens kept: {named}", stacklevel=4)


def _calibrate_row(cells: DataFrame, dims: list[str], keep: float, targets: dict[str, dict[str, float]] | None, temper: float) -> DataFrame:
    small = _Row(cells.select(*dims, "tokens"), targets, temper)
    row = small.factors(keep)
    found = cut(small.cells(row, keep))
    whole = float(found.agg(F.sum(F.col("own") * F.col("share"))).first()[0] or 1.0)
    missed = []
    for k, d in enumerate(dims):
        wanted = row.select(F.explode(F.arrays_zip(F.col(f"keys_{k}").alias("key"), F.col(f"want_{k}").alias("want"))).alias("x")).select("x.key", "x.want")
        got = found.groupBy(F.col(d).alias("key")).agg((F.sum(F.col("own") * F.col("share")) / whole).alias("got")).join(wanted, "key")
        missed += [(d, x.key, x.got, x.want) for x in got.filter(F.abs(F.col("got") - F.col("want")) > SLACK).orderBy(F.desc(F.abs(F.col("got") - F.col("want")))).limit(10).collect()]
    _report(missed, keep)
    given = found.select(*[F.col(d).alias(f"own_{d}") for d in dims], F.when(F.col("own") > 0, F.col("share")).otherwise(F.lit(1.0)).alias("probability"))
    on = [F.col(d).eqNullSafe(F.col(f"own_{d}")) for d in dims]
    return cells.join(given, reduce(Column.__and__, on)).select(*cells.columns, "probability")


def _shares(cells: DataFrame, asked: DataFrame, dim: str, amounts: list[str]) -> DataFrame:
    """(dimension, category, target, and the share of each amount) for a dimension of cells."""
    whole = cells.agg(*[F.sum(a) for a in amounts]).first()
    each = cells.groupBy(F.col(dim).alias("key")).agg(*[(F.sum(a) / F.lit(float(w or 1))).alias(a) for a, w in zip(amounts, whole, strict=True)])
    return each.join(asked, "key").select(F.lit(dim).alias("dimension"), F.col("key").alias("category"), F.col("goal").alias("target"), *amounts)


def margins(mixed: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """What a result of mix() holds: dimension, category (a null is "\\0"), target, expected and drawn share of the sample's tokens."""
    keyed = [F.coalesce(F.col(d).cast("string"), F.lit("\0")).alias(d) for d in dimensions]
    amounts = [F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") * F.col("probability")).alias("expected"), F.sum(F.when(F.col("sampled"), F.col("n_tokens")).otherwise(0)).alias("drawn")]
    cells = cut(mixed.select(*keyed, "n_tokens", "probability", "sampled").groupBy(*dimensions).agg(*amounts))
    return reduce(DataFrame.unionByName, [_shares(cells, goals(cells, d, targets), d, ["expected", "drawn"]) for d in dimensions])


def mix(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """docs with n_tokens, weight (raked over own tokens of the cell), probability and sampled. docs needs the dimensions and text."""
    names = ["n_tokens", "weight", "probability", "sampled"]
    base = docs.drop(*names).withColumn("n_tokens", tokens(F.col("text")))
    key = lambda d: F.coalesce(F.col(d).cast("string"), F.lit("\0"))
    keyed = [key(d).alias(f"cell_{d}") for d in dimensions]
    cells = cut(base.select(*keyed, "n_tokens").groupBy(*[f"cell_{d}" for d in dimensions]).agg(F.sum("n_tokens").alias("tokens")))
    wanted = {f"cell_{d}": t for d, t in (targets or {}).items()}
    final = cut(calibrate(rake(cells, wanted), keep, wanted)).withColumn("weight", F.when(F.col("tokens") > 0, F.col("raked") / F.col("tokens")).otherwise(0.0))
    final = final.select(*[f"cell_{d}" for d in dimensions], "weight", "probability")
    if final.count() <= BROADCAST_CELLS:
        final = F.broadcast(final)
    on = None
    for d in dimensions:
        same = key(d) == F.col(f"cell_{d}")
        on = same if on is None else on & same
    out = base.join(final, on).drop(*[f"cell_{d}" for d in dimensions])
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 40)) / float(1 << 40)
    return out.withColumn("sampled", draw < F.col("probability"))
