"""Checks of the query object alone."""

import pytest

from tessel.operators import discover as D
from tessel.plans import query as Q
from tessel.sources.connectors import camel, entity_label
from tessel.sources.csv_files import header_names
from tessel.sources.json_import import needs_label


def test_logic_objects_become_lists():
    assert Q.normalized({"$or": {"a": 1, "b": 2}}) == {"$or": [{"a": 1}, {"b": 2}]}
    assert Q.normalized({"f": {"$not": {"$gt": 4, "$lt": 9}}}) == {"f": {"$not": [{"$gt": 4, "$lt": 9}]}}


@pytest.mark.parametrize(
    ("value", "is_property"),
    [(1, True), (None, True), ({"$gt": 1}, True), ({"$or": [{"$gt": 1}, "a"]}, True), ({"$year": 1984}, True), ({}, False), ({"name": "x"}, False),
     ({"$relation": "R"}, False), ({"$alias": "$x"}, False), ({"$cycle": {"hops": 3}}, False), ({"$or": [{"name": "x"}]}, False), ({"$id": "a"}, False)],
)
def test_properties_and_related_records(value, is_property):
    assert Q.is_criteria(value) is is_property


@pytest.mark.parametrize("hops", [0, {"min": 3, "max": 2}, {"min": 1}, {"max": 11}, "x", True, {"min": 0, "max": 2}])
def test_wrong_hops(hops):
    with pytest.raises(Q.QueryError):
        Q.hops_of(hops)


def test_hops_and_relations():
    assert Q.hops_of(3) == (3, 3) and Q.hops_of({"max": 4}) == (1, 4) and Q.hops_of({"max": 6}, 2) == (2, 6)
    assert Q.relation_of("R") == ("R", None, None)
    assert Q.relation_of({"type": "R", "direction": "sideways"}) == ("R", None, None)
    with pytest.raises(Q.QueryError):
        Q.relation_of({"direction": "sideways", "hops": 2})


def test_pages():
    page = lambda **k: Q.SearchQuery.of(k).page()
    assert page() == (0, 100) and page(limit=1000) == (0, 1000) and page(limit=1001) == (0, 100) and page(skip=-5, limit=0) == (0, 100)


def test_select_layers_and_errors():
    assert Q.layers({"c": {"$divide": [{"$ref": "a"}, {"$ref": "b"}]}, "a": {"$count": "*"}, "b": 2}) == [["a", "b"], ["c"]]
    for wrong in ({"a": {"$ref": "a"}}, {"a": {"$ref": "b"}, "b": {"$ref": "a"}}, {"a": {"$ref": "z"}}):
        with pytest.raises(Q.QueryError):
            Q.layers(wrong)
    with pytest.raises(Q.QueryError):
        Q.SearchQuery.of({"select": {"a": 1}, "aggregate": {"a": {"fn": "count"}}})
    with pytest.raises(Q.QueryError):
        Q.SearchQuery.of({"lables": []})


def test_cost_and_validation():
    assert Q.is_heavy({"where": {"A": {"B": {"C": {}}}}}) and Q.is_heavy({"groupBy": ["x"]}) and not Q.is_heavy({"where": {"A": {"B": {"x": 1}}}})
    schema = {"A": {"x"}, "B": {"y"}}
    assert Q.validate({"labels": ["A"], "where": {"x": 1, "B": {"y": {"$gt": 2}}}}, schema) == []
    wrong = Q.validate({"labels": ["A", "Z"], "where": {"q": "$record.x", "C": {}}, "select": {"m": {"$sum": 1, "$avg": 1}}}, schema)
    assert len(wrong) == 5


def test_labels_of_json_and_csv_headers():
    assert all(map(needs_label, [[], {}, {"a": 1}, {"a": [1]}, {"a": [{}, 1]}])) and not needs_label({"A": {"x": 1}, "B": [{"x": 1}]})
    assert header_names([" a b ", None, "", "1x", "a_b", "a\0"]) == ["a_b", "column_2", "column_3", "_1x", "a_b_2", "a"]
    assert camel("user_first-name") == "userFirstName" and entity_label("companies") == "COMPANY" and entity_label("t", {"t": "X"}) == "X"


def test_discovery_by_names():
    assert D.tokens("winningDriverRefs") == ["winning", "driver", "ref"] and D.tokens("companies_2") == ["company", "2"]
    schema = {"Driver": {"code": "string"}, "Race": {"winnerDriverCode": "string", "held": "datetime"}}
    (c,) = D.suggest(schema)
    assert (c.source, c.source_key, c.target, c.target_key, c.type) == ("Race", "winnerDriverCode", "Driver", "code", "HAS_DRIVER")
    D.validate(c, schema)
    with pytest.raises(Q.QueryError):
        D.validate(D.Candidate("Race", "held", "Driver", "code", "X", 1), schema)
    with pytest.raises(Q.QueryError):
        D.validate(c, schema, linked={("Driver", "Race")})
    (chain,) = D.suggest_chains({"Depot": {"fromStation": "string", "toStation": "string", "size": "number"}})
    assert (chain.source_key, chain.target_key, chain.type) == ("toStation", "fromStation", "FLOWS_TO_STATION")
    a, b = D.Candidate("A", "x", "B", "y", "T", 0.8), D.Candidate("B", "y", "A", "x", "T", 0.9)
    assert D.rank([a, b]) == [b] and D.signature(schema, [a]) != D.signature(schema, [b])
