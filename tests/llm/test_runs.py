import itertools
import random

from prosopa.llm import runs

ROWS = "key long, pos int, state_no int, first_year int, last_year int"


def brute(rows):
    out = []
    rows = sorted(rows)
    for key, group in itertools.groupby(rows, key=lambda r: r[0]):
        run = []
        for r in [*group, None]:
            if run and (r is None or r[2] is None or r[2] != run[-1][2] or r[1] != run[-1][1] + 1):
                years = [y for x in run for y in x[3:] if y is not None]
                out.append((key, run[0][1], run[-1][1], run[0][2], len(run), min(years, default=None), max(years, default=None)))
                run = []
            if r is not None:
                run.append(r)
    return sorted(out, key=str)


def test_runs_against_brute_force_in_any_blocks(spark):
    rng = random.Random(4)
    rows = [(k, p, rng.choice([1, 1, 1, 2, None]), rng.choice([None, 900 + p]), rng.choice([None, 901 + p])) for k in range(4) for p in range(1, 60) if rng.random() < 0.95]
    rows += [(9, p, 3, None, None) for p in range(1, 40)]
    df = spark.createDataFrame(rows, ROWS)
    for block in (4096, 7, 1):
        got = [tuple(r) for r in runs.collapse_runs(df, block=block).collect()]
        assert sorted(got, key=str) == brute(rows), block


def test_states_match_by_one_slip(spark):
    states = spark.createDataFrame([(1, "domain_medical"), (2, "category_Toll Gates"), (3, "domain_medicals"), (None, "x"), (4, None)], "state_no int, state string")
    labels = ["domain_medical", "DOMAIN-MEDICAL", "dоmain medi​cal", "domain_medcial", "category: TollGates", "ｃategory_Toll Gate", "domain_medicals", "domain_mdeicla", "", None]
    got = {r.label: r.state_no for r in runs.match_states(spark.createDataFrame([(x,) for x in labels], "label string"), "label", states).collect()}
    assert got == {labels[0]: 1, labels[1]: 1, labels[2]: 1, labels[3]: 1, labels[4]: 2, labels[5]: 2, labels[6]: 3}


def test_entries_and_edge_cases(spark):
    schema = "id long, seq string, f array<int>, l array<int>, pos int"
    rows = [(1, "a > b＞c", [900, 0, None], [901], 5), (1, "a > b＞c", [900, 0, None], [901], 5), (2, None, None, None, 1), (3, "", [], [], 1)]
    got = sorted(tuple(r) for r in runs.entries(spark.createDataFrame(rows, schema), "id", "seq", "f", "l").collect())
    assert got == [(1, 1, "a ", 900, 901), (1, 2, " b", None, None), (1, 3, "c", None, None), (3, 1, "", None, None)]
    assert runs.entries(spark.createDataFrame([], schema), "id", "seq").count() == 0
