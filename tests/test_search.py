"""The search on the fixture tables, on a landscape of sixteen designs and on random ones."""

import itertools
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tesserae.operators import estimation, statistics
from tesserae.plans import costs
from tesserae.plans.search import Candidate, Evaluator, Move, Search, greedy_with_prefixes

FIXTURE = {
    "m0_single": ("a = 1 AND b = 1", 1000), "m0_overlap": ("a = 1 AND b = 1 AND c = 1", 800), "m0_fd": ("a = 1 AND b = 1", 100),
    "m0_mixed": ("a = 1 AND b = 1 AND c = 1", 500), "m0_unaffected": ("a = 1 AND b = 1", 1000),
}
CANDIDATES = [
    ("single_mcv", "m0_single", "mcv", "a", "b"), ("overlap_ab", "m0_overlap", "mcv", "a", "b"), ("overlap_bc", "m0_overlap", "mcv", "b", "c"),
    ("fd_ab", "m0_fd", "fd", "a", "b"), ("mixed_mcv", "m0_mixed", "mcv", "a", "b"), ("mixed_fd", "m0_mixed", "fd", "b", "c"),
]


def fixture_table(spark, name):
    g = F.col("g")
    overlap = F.when(g % 10 == 1, F.when(g % 5 < 4, 1).otherwise(2)).when(g % 8 == 0, 1).otherwise((g + 3) % 10)
    columns = {
        "m0_single": [g % 10, g % 10], "m0_overlap": [g % 10, g % 10, overlap], "m0_fd": [g % 100, g % 100],
        "m0_mixed": [g % 20] * 3, "m0_unaffected": [g % 10, g % 10],
    }[name]
    return spark.range(1, 10_001).withColumnRenamed("id", "g").select(*[c.cast("int").alias(n) for c, n in zip(columns, "abc")])


@pytest.fixture(scope="module")
def evaluator(spark):
    """Selectivities and factors of five tables, named apart by their query."""
    singles, factors = [], []
    for relation, (where, _) in FIXTURE.items():
        df = fixture_table(spark, relation)
        columns = df.columns
        values = [(relation, c, "1") for c in columns if f"{c} = 1" in where]
        preds = spark.createDataFrame(values, "query_id string, column string, value string")
        pairs = list(itertools.combinations(columns, 2))
        own = [(c, m, x, y, k) for k, (c, r, m, x, y) in enumerate(CANDIDATES) if r == relation]
        spread = statistics.distinct_counts(df, columns).withColumn("rows", F.lit(10_000))
        sel = estimation.single_selectivities(preds, statistics.column_mcv(df, columns, 100), spread)
        singles += [tuple(r) for r in sel.select("query_id", "column", "sel").collect()]
        if own:
            cands = spark.createDataFrame(own, "candidate_id string, mechanism string, c1 string, c2 string, precedence_rank int")
            f = estimation.pair_factors(preds, sel, cands, statistics.pair_mcv(df, pairs, 100), statistics.fd_degrees(df, pairs))
            factors += [tuple(r) for r in f.select("query_id", "candidate_id", "mechanism", "precedence_rank", "c1", "c2", "factor").collect()]
    return lambda: Evaluator(singles, factors, {r: t for r, (_, t) in FIXTURE.items()}, 10_000)


@pytest.mark.parametrize(
    "budget,design,objective,cost,evaluations,calls,skipped",
    [
        (0, (), 646.6666666666666, 0, 1, 5, 12),
        (4, ("overlap_ab", "mixed_mcv"), 142.66666666666666, 4, 16, 23, 14),
        (20, ("single_mcv", "overlap_ab", "fd_ab", "mixed_mcv"), 34.666666666666664, 9, 35, 45, 0),
    ],
)
def test_fixture_goldens(evaluator, budget, design, objective, cost, evaluations, calls, skipped):
    own = [Candidate(c, m, x, y, k) for k, (c, _, m, x, y) in enumerate(CANDIDATES)]
    result = Search(own, evaluator(), costs.preset(), Decimal(budget), prune=False).run()
    assert result.design == design and result.objective == pytest.approx(objective, rel=1e-12)
    assert (result.cost, result.evaluations, result.calls, result.infeasible) == (cost, evaluations, calls, skipped)
    pruned = Search(own, evaluator(), costs.preset(), Decimal(budget)).run()
    assert pruned.design == design and pruned.objective == result.objective and pruned.calls <= result.calls


class Landscape:
    """Objectives of whole designs as one query that every candidate affects."""

    def __init__(self, objectives):
        self.objectives, self.calls = objectives, 0

    def full(self, design):
        self.calls += 1
        return {"q": float(self.objectives[design])}

    def after(self, state, design, move):
        return self.full(design)

    def hit(self, move):
        return ["q"]


TEXT = "∅100 A60 B70 C80 D90 AB50 AC55 AD58 BC40 BD65 CD30 ABC45 ABD49 ACD32 BCD35 ABCD44"


def landscape():
    out = {}
    for item in TEXT.split():
        name = item.rstrip("0123456789")
        out[frozenset(name.replace("∅", ""))] = int(item[len(name) :])
    return out


def four():
    return [Candidate(c, "mcv", "a", "b", k) for k, c in enumerate("ABCD")]


def test_landscape():
    def run(budget):
        return Search(four(), Landscape(landscape()), costs.preset(0, 1, 0, 1), Decimal(budget), prune=False).run()

    assert run(0).design == ()
    assert any(s["kind"] == "SWAP" for s in run(4).trajectory)
    six = run(6)
    assert six.design == ("C", "D") and any(s["kind"] == "DROP" for s in six.trajectory)
    assert run(10).objective == 30


def test_random_landscapes_prune_to_the_same_result():
    r = random.Random(11)
    for _ in range(40):
        names = "ABCDE"
        values = {frozenset(c): r.randint(1, 20) for k in range(6) for c in itertools.combinations(names, k)}
        own = [Candidate(c, "mcv", "a", "b", k) for k, c in enumerate(names)]
        both = [Search(own, Landscape(values), costs.preset(0, 1, 0, 1), Decimal(6), prune=p).run() for p in (False, True)]
        assert both[0].design == both[1].design and both[0].objective == both[1].objective
        assert both[0].trajectory == both[1].trajectory


def test_pruning_on_random_workloads():
    r = random.Random(3)
    for _ in range(20):
        queries = [f"q{k}" for k in range(8)]
        singles = [(q, c, r.random()) for q in queries for c in "abc"]
        own = [Candidate(f"c{k}", r.choice(["mcv", "fd"]), *p, k) for k, p in enumerate([("a", "b"), ("a", "c"), ("b", "c")] * 2)]
        factors = [(q, c.candidate_id, c.mechanism, c.rank, c.c1, c.c2, r.random()) for q in queries for c in own if r.random() < 0.5]
        truth = {q: r.randint(1, 1000) for q in queries}
        results = [Search(own, Evaluator(singles, factors, truth, 1000), costs.preset(), Decimal(9), prune=p).run() for p in (False, True)]
        assert results[0].design == results[1].design and results[0].objective == results[1].objective
        e = Evaluator(singles, factors, truth, 1000)
        design, state = frozenset(), e.full(frozenset())
        for c in own:  # incremental equals full
            move = Move(add=c.candidate_id)
            design = move.apply(design)
            state = e.after(state, design, move)
            assert state == e.full(design)


def test_deadline_keeps_the_last_accepted_state():
    ticks = iter(range(1000))
    result = Search(four(), Landscape(landscape()), costs.preset(0, 1, 0, 1), Decimal(10), prune=False, deadline=6, clock=lambda: next(ticks)).run()
    assert not result.complete and result.design == ("A",) and result.objective == 60


def test_moves_and_catalogs_are_checked():
    with pytest.raises(ValueError):
        Move().kind  # noqa: B018
    with pytest.raises(ValueError):
        Move(add="A").apply(frozenset("A"))
    with pytest.raises(ValueError):
        Search([*four(), four()[0]], Landscape(landscape()), costs.preset(), Decimal(1))


def test_held_out_prefixes(evaluator):
    own = [Candidate(c, m, x, y, k) for k, (c, _, m, x, y) in enumerate(CANDIDATES)]
    steps = greedy_with_prefixes(Search(own, evaluator(), costs.preset(), Decimal(20)), evaluator())
    assert [s["held_out"] for s in steps][-1] == pytest.approx(34.666666666666664)
    assert all(math.isclose(s["objective"], s["held_out"]) for s in steps[1:])
