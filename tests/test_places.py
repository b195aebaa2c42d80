import pytest

from tessera.plans.catalog import QUERIES


@pytest.mark.parametrize("name", ["q05_identifiers", "q06_names", "q08_row_dates", "q09_row_amounts"])
def test_values_have_all_their_places(spark, name):
    rows = QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    seen = {}
    for r in rows:
        seen.setdefault((r["value"], r["n_docs"], r["anchor"]), []).append((r["doc"], r["place"]))
    assert rows and all(len({d for d, _ in at}) == n and first in {p for _, p in at} and len(set(at)) == len(at) for (_, n, first), at in seen.items())
