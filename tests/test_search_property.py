"""Property: on random small catalogs and random filters, the factorised search
equals the direct row-filter-then-group form."""

from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.test_search_bruteforce import as_set, direct
from wearhouse.operators import catalog
from wearhouse.sources.tables import tables_from_rows

WORDS = ["red", "Blue", "top", "warm", "", "re", "wool", "Éte"]
item_ids = st.integers(min_value=1, max_value=6)


@st.composite
def catalogs(draw):
    items = [(i, 1 + i % 2, draw(st.sampled_from(WORDS)) + " item", draw(st.sampled_from(["M", "", None])), None)
             for i in range(1, 7)]
    def pairs():
        return sorted(set(draw(st.lists(st.tuples(item_ids, st.sampled_from(WORDS)), max_size=10))))
    return {
        "w_user": [(1, "a", None, "user")],
        "w_closet": [(1, "c1", 1), (2, "c2", 1)],
        "w_item": items, "w_tag": pairs(), "w_cat": pairs(), "w_color": pairs(), "w_img": pairs(),
    }


filters = st.fixed_dictionaries({
    "q": st.sampled_from([None, "re", "e", "top", "%", "é", "m"]),
    "category": st.sampled_from([None, "red", "top", ""]),
    "color": st.sampled_from([None, "Blue", "warm"]),
    "tag": st.sampled_from([None, "re", "wool"]),
})


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(rows=catalogs(), f=filters)
def test_factorised_search_property(spark, rows, f):
    t = tables_from_rows(spark, rows)
    assert as_set(catalog.search(t, **f)) == as_set(direct(t, **{k: (v or None) for k, v in f.items()}))
