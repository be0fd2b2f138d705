import itertools
import random

import pytest

from treeline.functions.stats import estimated_fanout
from treeline.model import Entity, JoinTree, QueryTemplate, Relation
from treeline.plans.advisor import Advisor, Design, Pick
from treeline.plans.cost import CostParams, ViewSpec, instance_cards, total_cards
from treeline.plans.cover import find_covers, is_complete
from treeline.plans.generate import random_workload

K, D, E, C = Entity("keyword", 1000), Entity("document", 1000), Entity("entity", 800), Entity("category", 10)
PARAMS = CostParams(seek=10000, first_limit=1010, last_limit=2**32 - 1, wt_maint=0.1)


def rel(name, left, right, tuples):
    return Relation(name, left, right, estimated_fanout(tuples, left.card, right.card), estimated_fanout(tuples, right.card, left.card))


KD = rel("kd", K, D, 50000)
ED = rel("ed", E, D, 10000)
DE = ED.inverse("de")
CE = rel("ec", E, C, 800).inverse("ce")
QUERY = JoinTree((*(JoinTree.leaf(e, n).nodes[0] for e, n in ((E, "e"), (D, "d"), (K, "k1"), (K, "k2"), (C, "c"))),), (None, 0, 1, 1, 0), (None, DE, KD, KD, CE))
near = lambda *x: pytest.approx(x if len(x) > 1 else x[0], rel=1e-3)


def test_fanouts():
    assert (KD.n_rgl, KD.n_lgr) == near(48.794, 48.794)
    assert (ED.n_rgl, ED.n_lgr) == near(12.428, 9.944)
    assert (CE.n_lgr, CE.n_rgl) == near(1.000, 76.175)
    assert estimated_fanout(50000, 600, 600) == near(77.866)


def test_cardinalities():
    assert tuple(instance_cards(QUERY)) == near(2.235, 1.463, 0.777, 0.777, 0.916)
    assert tuple(total_cards(QUERY)) == near(505.879, 998.212, 1000, 1000, 10)


def chain(*steps):
    """A tree from its leaf upwards: (relation, parent name)."""
    tree = JoinTree.edge(steps[0][0], steps[0][1], steps[0][2])
    for r, name in steps[1:]:
        tree = tree.add_root(r, name)
    return tree


KDE = chain((KD, "k", "d"), (DE, "e"))
GOLDEN = [
    (chain((KD, "k", "d")), ["k", "d"], [[1], [1]], [1000, 48.794], 49795.37, 7805.36),
    (chain((DE, "d", "e")), ["d", "e"], [[1], [1]], [999.955, 9.944], 10944.41, 14639.44),
    (chain((CE, "c", "e")), ["c", "e"], [[1, 1]], [491.695], 492.70, 0),
    (chain((DE, "d", "e")).add_leaf(0, CE, "c"), ["d", "c", "e"], [[1], [1, 1]], [998.212, 15.987], 16958.04, 14622.75),
    (KDE, ["k", "d", "e"], [[1], [1, 1]], [1000, 533.977], 534977.62, 8182.22),
    (KDE.add_leaf(KDE.root, CE, "c"), ["k", "c", "d", "e"], [[1], [1, 1, 1]], [1000, 788.701], 789701.93, 8380.08),
]


@pytest.mark.parametrize("tree,columns,groups,sizes,maintenance,time", GOLDEN)
def test_view_costs(tree, columns, groups, sizes, maintenance, time):
    view = ViewSpec(tree, PARAMS)
    assert [tree.nodes[n].name for n in view.columns] == columns
    assert [len(g) for g in view.layout[0]] == [len(g) for g in groups]
    assert view.layout[1] == pytest.approx(sizes, rel=1e-3) and view.maintenance == near(maintenance)
    for cover in find_covers(view, QueryTemplate("q", QUERY)):
        assert cover.time_under == pytest.approx(time, rel=1e-3, abs=1e-9)


def test_isomorphic_siblings_give_two_covers():
    query = QueryTemplate("q", QUERY)
    covers = find_covers(ViewSpec(KDE), query)
    assert [c.goals for c in covers] == [{2, 1}, {3, 1}]
    assert not is_complete(query, covers) and is_complete(query, [*covers, *find_covers(ViewSpec(chain((CE, "c", "e"))), query)])


def test_trees_are_checked():
    with pytest.raises(ValueError):
        JoinTree.compose(E, "e", [(KD, JoinTree.leaf(K, "k"))])
    with pytest.raises(ValueError):
        JoinTree((*QUERY.nodes[:2],), (1, 0), (DE, KD))
    with pytest.raises(ValueError):
        QUERY.rename(["a"] * 5)
    assert QUERY.levels == (3, 2, 1, 1, 1) and QUERY.distances == (0, 1, 2, 2, 1) and QUERY.inputs == (2, 3, 4)
    other = JoinTree.compose(E, "x", [(CE, JoinTree.leaf(C, "y")), (DE, JoinTree.compose(D, "z", [(KD, JoinTree.leaf(K, "a")), (KD, JoinTree.leaf(K, "b"))]))])
    assert other.key() == QUERY.key() and KDE.key() != QUERY.key() and str(KDE) == "e(de: d(kd: k))"


def all_designs(advisor):
    """Least cost over every set of covers, in order of position."""
    best = float("inf")
    for n in range(1, len(advisor.covers) + 1):
        for ks in itertools.combinations(range(len(advisor.covers)), n):
            d = Design()
            for k in ks:
                if advisor.goals[k] <= d.covered:
                    break
                d = advisor.extend(d, k)
            else:
                if advisor.is_complete(d):
                    best = min(best, d.cost)
    return best


@pytest.mark.parametrize("pick", list(Pick))
def test_search_finds_the_optimum(pick):
    for params in (PARAMS, CostParams()):
        advisor = Advisor([QueryTemplate("a", QUERY, 0.7), QueryTemplate("b", KDE, 0.3)], params, max_depth=2)
        best = all_designs(advisor)
        result = advisor.optimize(pick)
        assert result.cost == pytest.approx(best)
        assert all(is_complete(q, result.covers_of(q)) for q in advisor.queries)
        assert [c for _, c in result.trace] == sorted((c for _, c in result.trace), reverse=True)


def test_knobs_and_determinism():
    rels = [KD, ED, DE, CE, CE.inverse("ec"), KD.inverse("dk")]
    for seed in range(3):
        queries = random_workload(rels, 2, 2, seed=seed, prob_const=0.5)
        assert queries == random_workload(rels, 2, 2, seed=seed, prob_const=0.5)
        assert sum(q.weight for q in queries) == pytest.approx(1) and all(q.tree.levels[q.tree.root] >= 3 for q in queries)
        runs = [Advisor(queries, PARAMS).optimize(Pick.OPEN, refresh=2, num_expand=3, max_iters=150) for _ in range(2)]
        assert str(runs[0]) == str(runs[1]) and runs[0].states <= 150 + len(runs[0].advisor.covers)
        assert all(is_complete(q, runs[0].covers_of(q)) for q in queries)


def test_times_are_bounded_below():
    advisor = Advisor([QueryTemplate("a", QUERY)], PARAMS)
    rng = random.Random(1)
    for k in rng.sample(range(len(advisor.covers)), min(8, len(advisor.covers))):
        assert advisor.covers[k].time_under <= advisor.covers[k].time_after(frozenset()) + 1e-6


def test_small_workload_s_optimum_by_trying_all():
    from treeline.queries import SMALL_OPTIMUM, _small_workload

    advisor = Advisor(_small_workload(), CostParams(10, 100, 2**32 - 1, 0.1), max_depth=3)
    assert all_designs(advisor) == pytest.approx(SMALL_OPTIMUM, abs=1e-6)
