"""One attribution run for a table of slices, stage by stage.

``slices`` has ``slice_id`` and ``dims`` (dimension to list of codes); a slice may fix any of the cube's dimensions, each to several
codes. All slices go through pairs, contributions, hypotheses, tests, checks and verdicts together: a slice
is a key, not a job. Every stage is committed to the run's store once and read from there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltatree.functions import replicates as R
from deltatree.functions.periods import Period
from deltatree.operators import decompose as D
from deltatree.operators import hypotheses as H
from deltatree.operators import values as V
from deltatree.operators.tree import MetricTree
from deltatree.sources.store import RunStore


def with_total(slices: DataFrame) -> DataFrame:
    """``slices`` with ``asked``, and the total, which shares need, if it isn't one of them."""
    asked = slices.select("slice_id", "dims", F.lit(True).alias("asked"))
    total = slices.sparkSession.range(1).select(
        F.lit(V.ALL).alias("slice_id"), F.create_map().cast("map<string,array<string>>").alias("dims"), F.lit(False).alias("asked"))
    return asked.unionByName(total.join(slices.select("slice_id"), "slice_id", "left_anti"))


@dataclass(frozen=True)
class Attribution:
    """The stages of a run. ``build_cube`` gives a stored daily cube; what else is built is asked only where its stage isn't committed.

    A slice that can't be used (see ``check_slices``) keeps its row in ``slices`` with a status, has pairs without values,
    contributions with ``missing_value`` and no hypotheses. Rows of a slice are the rows of the cube that have one of its codes in
    each dimension it fixes; a row counts once, however often a code is listed.
    """

    store: RunStore
    tree: MetricTree
    base: Period
    current: Period
    observed: Period
    dims: Sequence[str]
    build_cube: Callable[[], DataFrame]
    build_slices: Callable[[DataFrame], DataFrame]
    #: Hypotheses to test instead of the largest factors, from the cube.
    build_hypotheses: Callable[[DataFrame], DataFrame] | None = None
    #: Nodes below the root that are split too, where their factors are positive.
    targets: Sequence[str] | None = None
    replicates: int = R.PERMUTATIONS
    seed: int = R.SEED

    @cached_property
    def cube(self) -> DataFrame:
        return self.build_cube()

    @cached_property
    def slices(self) -> DataFrame:
        def build() -> DataFrame:
            rows = with_total(self.build_slices(self.cube))
            return rows.join(V.check_slices(rows, self.cube, self.dims), "slice_id")

        return self.store.stage("slices", build, ("slice_id",))

    @cached_property
    def pairs(self) -> DataFrame:
        return self.store.stage("pairs", lambda: V.slice_pairs(
            self.cube, self.slices, self.tree, self.base, self.current, self.dims), ("slice_id",))

    @cached_property
    def contributions(self) -> DataFrame:
        def build() -> DataFrame:
            asked = self.slices.where("asked").select("slice_id")
            return D.decompose(self.pairs.join(asked, "slice_id", "left_semi"), self.tree, ["slice_id"], auto_targets=self.targets)

        return self.store.stage("contributions", build, ("slice_id",))

    @cached_property
    def shares(self) -> DataFrame:
        return H.slice_shares(self.pairs, self.tree.root.code)

    @cached_property
    def hypotheses(self) -> DataFrame:
        def build() -> DataFrame:
            if self.build_hypotheses:
                return self.build_hypotheses(self.cube)
            return H.candidates(self.contributions, self.slices.select("slice_id", "dims"), self.tree)

        return self.store.stage("hypotheses", build, ("slice_id",))

    @cached_property
    def tests(self) -> DataFrame:
        """What is to be tested: the sides of every test by the name of their slice."""
        return self.store.stage("tests", lambda: H.tests_for(self.hypotheses, self.cube, self.tree))

    @cached_property
    def series(self) -> DataFrame:
        """Daily values of every slice that a test or an order of deviations needs, each once, by the name of the slice."""
        def build() -> DataFrame:
            own = self.hypotheses.select("dims")
            sides = H.test_sides(self.tests).select("dims").unionByName(own)
            needed = sides.withColumn("slice_id", V.slice_name(F.col("dims"))).groupBy("slice_id").agg(F.first("dims").alias("dims"))
            return H.slice_series(self.cube, self.tree, needed, self.observed, self.dims)

        return self.store.stage("series", build, ("slice_id",))

    @cached_property
    def results(self) -> DataFrame:
        return self.store.stage("results", lambda: H.run_tests(
            self.tests, H.sides_series(H.test_sides(self.tests), self.series), self.replicates, self.seed))

    @cached_property
    def verified(self) -> DataFrame:
        return self.store.stage("verified", lambda: H.verify(self.hypotheses, self.results, self.shares, window=self.observed))

    @cached_property
    def deviations(self) -> DataFrame:
        """First deviation of every metric for the slices that have hypotheses."""
        def build() -> DataFrame:
            names = self.hypotheses.groupBy("slice_id").agg(F.first("dims").alias("dims")).select(
                "slice_id", V.slice_name(F.col("dims")).alias("name"))
            own = self.series.withColumnRenamed("slice_id", "name").join(names, "name")
            return H.first_deviation(own, ["slice_id", "factor"])

        return self.store.stage("deviations", build, ("slice_id",))

    @cached_property
    def checks(self) -> DataFrame:
        return self.store.stage("checks", lambda: H.spurious_checks(
            self.hypotheses, self.results, self.deviations, self.tree.root.code, window=self.observed))

    @cached_property
    def verdicts(self) -> DataFrame:
        return self.store.stage("verdicts", lambda: H.apply_checks(self.verified, H.combine_checks(self.checks)), ("slice_id",))

    def steps(self) -> DataFrame:
        """What the run did for each slice, as rows ``(slice_id, seq, kind, status, nodes, residual, count, factor, confidence, verdict)``.

        1 query: the split; 2 hypothesis: how many; from 3 on verify: one for each hypothesis, in the order of their rank.
        """
        split = self.contributions.groupBy("slice_id").agg(
            F.array_join(F.sort_array(F.collect_set("node")), ",").alias("nodes"), F.max("relative").alias("residual"),
            F.when(F.min(F.col("status").isin("ok", "zero_substituted")), "completed").otherwise(F.max("status")).alias("status"))
        counted = self.contributions.select("slice_id").distinct().join(
            self.hypotheses.groupBy("slice_id").agg(F.count(F.lit(1)).alias("count")), "slice_id", "left")
        none = {"nodes": "string", "residual": "double", "count": "long", "factor": "string", "confidence": "double", "verdict": "string"}

        def shaped(rows: DataFrame, seq, kind: str, status) -> DataFrame:
            return rows.select("slice_id", seq.cast("int").alias("seq"), F.lit(kind).alias("kind"), status.alias("status"), *[
                (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

        judged = self.verdicts.withColumn("confidence", F.round("final_confidence", 4))
        return (
            shaped(split, F.lit(1), "query", F.col("status"))
            .unionByName(shaped(counted.withColumn("count", F.coalesce("count", F.lit(0))), F.lit(2), "hypothesis", F.lit("completed")))
            .unionByName(shaped(judged, F.col("rank") + 2, "verify", F.col("status")))
        )

    def hypothesis_rows(self) -> DataFrame:
        """Rows of the hypotheses as they are kept: statement, expected direction, final status, confidence, reason and scores."""
        return self.verdicts.select(
            "slice_id", "hypothesis_id", "statement", "verification", "counter_check", "measure_sql", F.col("direction").alias("expected_direction"), "status", F.col("final_confidence").alias("confidence"),
            "reason", "significance_score", "effect_score", "coverage_score", "direction_ok", F.coalesce("penalty", F.lit(0.0)).alias("penalty"), "verdict")

    def evidence_rows(self) -> DataFrame:
        """Rows of the evidence: one per test, with its sample, p-value and effect."""
        return self.results.join(self.hypotheses.select("hypothesis_id", "slice_id"), "hypothesis_id").select(
            "slice_id", "hypothesis_id", "test_id", F.col("kind").alias("test_kind"), "code", (F.col("n_in") + F.col("n_out")).alias("sample_size"), "n_in", "n_out",
            "mean_in", "mean_out", "p_value", F.col("effect").alias("effect_size"))
