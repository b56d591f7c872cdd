import pytest

from quillspark.operators import links, search, trigrams as G
from tests.core.conftest import at


@pytest.fixture(scope="module")
def index(ws, tmp_path_factory):
    return G.write_index(links.documents(ws), str(tmp_path_factory.mktemp("index") / "i"))


@pytest.mark.parametrize("few", [G.FEW, 0])
@pytest.mark.parametrize("query", ["throttle", "THERM%tat re", "idle.pdf", "a_b\\c", "pro", "À pr", "xyz", "th", "", "%", "a%b", "stuck\n therm", "e%cle_ning"])
def test_same_rows_as_without(ws, index, monkeypatch, query, few):
    monkeypatch.setattr(G, "FEW", few)
    want = search.search_documents(links.documents(ws), query)
    assert G.search_documents(links.documents(ws), index, query).collect() == want.collect()


def test_postings_and_filters(ws, index):
    assert G.grams_of(" Ab%cDéF_gh ") == ["cdé", "déf"] and G.grams_of("ab") == [] == G.grams_of(None)
    assert index.count() == index.distinct().count() and {r.id for r in index.filter("gram = 'thr'").collect()} == {3}
    assert [r.id for r in G.search_documents(links.documents(ws), index, "the", system="Cooling").collect()] == [1]
    plan = G.candidates(index, "thermostat")._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in plan  # the letters reach the scan
    found = G.search_documents(links.documents(ws), index, "thermostat")
    assert [r.id for r in found.collect()] == [1] and at(1)
    assert G.candidates(index, "th") is None
