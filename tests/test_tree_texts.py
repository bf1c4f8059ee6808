"""Trees to text without a pandas group for each graph and without a join of nodes and links."""

import json

from hyperloom.sources import text_formats


def test_one_shuffle_and_the_same_texts(spark, capsys):
    rows = [(1, 1, None, [3, 4], [7]), (1, 2, 1, [4], [8, 9]), (1, 3, 1, [], [8]), (2, 5, None, [1], [2])]
    tree = spark.createDataFrame(rows, "g long, node int, parent int, bag array<bigint>, cover array<bigint>")
    texts, gml = text_formats.tree_json(tree), text_formats.tree_gml(tree)
    assert {r["g"]: json.loads(r["json"]) for r in texts.collect()} == {
        1: {"Root": {"Bag": ["3", "4"], "Cover": ["7"], "Children": [{"Bag": ["4"], "Cover": ["8", "9"], "Children": None}, {"Bag": [], "Cover": ["8"], "Children": None}]}},
        2: {"Root": {"Bag": ["1"], "Cover": ["2"], "Children": None}},
    }
    node = '  node [\n    id {}\n    label "{}"\n  ]\n'.format
    link = "  edge [\n    source {}\n    target {}\n  ]\n".format
    assert {r["g"]: r["gml"] for r in gml.collect()} == {
        1: "graph [\n  directed 0\n" + node(1, "{7}{3, 4}") + node(2, "{8, 9}{4}") + node(3, "{8}{}") + link(1, 2) + link(1, 3) + "]\n", 2: "graph [\n  directed 0\n" + node(5, "{2}{1}") + "]\n",
    }
    for frame in (texts, gml):
        frame.explain()
        plan = capsys.readouterr().out
        assert "FlatMapGroupsInPandas" not in plan and "Join" not in plan
