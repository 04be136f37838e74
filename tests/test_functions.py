"""Meaning of the column functions on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from curate.functions import labels, records, text, urls, vectors
from curate.operators import filters


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url, tld",
    [
        ("https://www.gla.ac.uk/a/b", "ac.uk"),
        ("http://scotsleid.org.uk", "org.uk"),
        ("http://www.alba.sco/", "sco"),
        ("https://en.wikipedia.org/wiki/X?y=1#z", "org"),
        ("http://user:pw@site.example.com:8080/x", "com"),
        ("http://example.com./", "com"),
        ("HTTP://EXAMPLE.COM", "com"),
        ("http://192.168.0.1/", None),
        ("http://host.unknownsuffix/", "unknownsuffix"),
        ("http://shop.example.xyz/", "xyz"),
        ("http://louvre.gouv.fr/", "gouv.fr"),
        ("http://www.kuleuven.ac.be/", "ac.be"),
        ("http://x.y.kawasaki.jp/", "y.kawasaki.jp"),
        ("http://city.kawasaki.jp/", "kawasaki.jp"),
        ("http://www.ck/", "ck"),
        ("http://a.b.ck/", "b.ck"),
        ("http://localhost/", "localhost"),
        ("not a url", None),
        ("http://", None),
        ("http://exa mple.com/", None),
        ("", None),
    ],
)
def test_url_tld(spark, url, tld):
    frame = spark.createDataFrame([(url,)], "url string")
    assert urls.url_tld(frame, "url").first()["tld"] == tld
    table = spark.createDataFrame([(r,) for r in urls.RULES], "rule string")
    assert urls.url_tld(frame, "url", rules=table).first()["tld"] == tld


def test_url_tld_with_own_list_and_null(spark):
    frame = spark.createDataFrame([("http://a.b.c.d/",), (None,)], "url string")
    found = [r["tld"] for r in urls.url_tld(frame, "url", rules=["c.d", "b.c.d", "d"]).collect()]
    assert found == ["b.c.d", None]


def test_url_parts(spark):
    frame = spark.createDataFrame([("https://www.gla.ac.uk/x",), ("nothing",)], "url string")
    got = [tuple(r)[1:] for r in urls.url_parts(frame, "url", 5).collect()]
    assert got == [("https", "www", "gla", "ac", "uk", None), (None,) * 6]


def test_extract_year(spark):
    assert one(spark, text.extract_year("d"), d="CC-MAIN-2013-20") == "2013"
    assert one(spark, text.extract_year("d"), d="none") is None


def test_path_tail(spark):
    assert one(spark, text.path_tail("p", 4), p="http://x/a/b/c/d.jpg") == "a/b/c/d.jpg"
    assert one(spark, text.path_tail("p", 4), p="c/d.jpg") == "c/d.jpg"


def test_normalize_instruction(spark):
    assert one(spark, text.normalize_instruction("t"), t="  Do\n\tthis   now::") == "Do this now"
    odd = "\u00a0Do\u2028\x1fthis\u3000\x85now: "
    assert one(spark, text.normalize_instruction("t"), t=odd) == " ".join(odd.split()).rstrip(":")


def test_front_matter(spark):
    card = "---\na: 1\nb: 2\n---\nbody\n---\nrest"
    assert one(spark, text.front_matter("c"), c=card) == "a: 1\nb: 2"
    assert one(spark, text.card_body("c"), c=card) == "body\n---\nrest"
    assert one(spark, text.front_matter("c"), c="x\n---\n---\n") is None
    assert one(spark, text.card_body("c"), c="no header") == "no header"


def test_prefix_levels(spark):
    assert one(spark, text.prefix_levels("c"), c="25F9") == ["2", "25", "25F", "25F9"]
    assert one(spark, text.prefix_levels("c"), c="") == []


def test_any_token_startswith(spark):
    assert one(spark, filters.any_token_startswith("c", " ", "cs."), c="math.CO cs.CL")
    assert not one(spark, filters.any_token_startswith("c", " ", "cs."), c="physics.cs.X")
    assert one(spark, filters.any_token_startswith("c", "|", "b"), c="a|b")


def test_regex_search_is_not_literal(spark):
    assert one(spark, filters.contains_regex("t", "ac.uk"), t="acXuk")


@pytest.mark.parametrize(
    "reply, block",
    [
        ('x\n```json\n{"a": {"b": 1}}\n```\ny', '{"a": {"b": 1}}\n'),
        ('```json\n{"a": \n```\n{"b": 2}', None),  # the brace group starts at the first brace
        ('```json\nbroken\n``` and {"b": 2}', '{"b": 2}'),
        ('so {"b": 2} and {"c": 3}', '{"b": 2}'),
        ('so {"a": {"b": 1}}', None),  # the fallback knows no nested braces
        ("no json at all", None),
        (None, None),
    ],
)
def test_extract_json_block(spark, reply, block):
    frame = spark.createDataFrame([(reply,)], "r string")
    assert frame.select(records.extract_json_block("r")).first()[0] == block


@pytest.mark.parametrize(
    "text, valid",
    [
        ('{"a": {"b": [1, null]}}', True), ("[1, 2]", True), ("3", True), ("null", True), (' {"a": 1}\n', True),
        ('{"a": 1, "a": 2}', True), ('{"a": "]}"}', True), ('{"a": 1} x', False), ("1, 2", False), ("1], [2", False),
        ("1]], [[2", False), ('1}, {"y": 2', False), ('1, "y": 2', False), ("{'a': 1}", False), ("", False), ("{", False),
        ('{"a": "x\ny"}', False), ("tru", False), (None, None),
    ],
)
def test_is_json(spark, text, valid):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(records.is_json("t")).first()[0] is valid


def test_parse_json_record(spark):
    frame = spark.createDataFrame([('{"a": "x", "n": 1}',), ('{"a": "x"',), (None,), ('{"n": 2}',), ("[1]",)], "j string")
    got = [tuple(r)[1:] for r in records.parse_json_record(frame, "j", "a string, n int").collect()]
    assert got == [(True, "x", 1), (False, None, None), (False, None, None), (True, None, 2), (False, None, None)]


def test_validate_record(spark):
    frame = spark.createDataFrame(
        [("a" * 60, "meme", ["cat", "dog"]), ("short", "film", ["x", "abc", "abd", "abe"]), (None, None, None)],
        "d string, c string, t array<string>",
    )
    rules = [
        records.required("d"),
        records.min_length("d", 50),
        records.max_length("d", 55),
        records.one_of("c", ["meme", "other"]),
        records.max_items("t", 3),
        records.each_min_length("t", 3),
    ]
    got = [r["violations"] for r in records.validate_record(frame, rules).collect()]
    assert got == [
        ["d:too_long"],
        ["d:too_short", "c:not_allowed", "t:too_many_items", "t:item_too_short"],
        ["d:missing"],
    ]


def test_parse_delimited_annotations(spark):
    generated = "Ada -|- person -|- wrote programs\n\nbroken line\nParis -|- city -|- in France\na -|- b"
    frame = spark.createDataFrame([(1, generated)], "id int, g string")
    got = [tuple(r) for r in records.parse_delimited_annotations(frame, "g").collect()]
    assert got == [(1, "Ada", "person", "wrote programs"), (1, "Paris", "city", "in France")]


def test_build_messages(spark):
    chat = one(spark, records.build_messages("p", F.to_json(F.array(F.lit("25F"))), "Be brief."), p="Look")
    assert [tuple(m) for m in chat] == [("system", "Be brief."), ("user", "Look"), ("assistant", '["25F"]')]


def test_metadata_state(spark):
    frame = spark.createDataFrame(
        [(None, None), ("c", None), ("c", ["en"]), ("c", [])], "card string, langs array<string>"
    )
    got = [r[0] for r in frame.select(records.metadata_state("card", "langs")).collect()]
    assert got == ["No card data", "false", "true", None]


def test_has_nested_value(spark):
    frame = spark.createDataFrame([([("README.md",)],), ([(None,)],), ([],), (None,)], "f array<struct<name: string>>")
    got = [r[0] for r in frame.select(records.has_nested_value("f", "name", "README")).collect()]
    assert got == [True, False, False, False]


def test_drop_invalid_boxes(spark):
    frame = spark.createDataFrame(
        [(1, [([1.0, 2.0],), ([0.0, 3.0],)]), (2, [([1.0, -0.5],)]), (3, []), (4, None)],
        "id int, objects array<struct<bbox: array<double>>>",
    )
    assert [r["id"] for r in filters.drop_invalid_boxes(frame).collect()] == [1, 3, 4]


def test_url_lists(spark):
    entries = ["http://www.school.example/", "news.example/easy/", "http://kids.example/"]
    frame = spark.createDataFrame(
        [("http://www.school.example/",), ("http://www.school.example/x",), ("news.example/easy/1",), (None,)], "u string"
    )
    assert filters.keep_urls(frame, "u", entries).count() == 1
    assert filters.keep_urls(frame, "u", entries, "prefix").count() == 3
    assert [r["u"] for r in filters.drop_prefix_url(frame, "u", entries, "prefix").collect()] == [None]
    with pytest.raises(ValueError):
        filters.match_urls("u", entries, "suffix")


def test_softmax(spark):
    frame = spark.createDataFrame([([1.0, 2.0, 3.0],), ([1000.0, 1000.0, 0.0],)], "s array<double>")
    probs = [r[0] for r in frame.select(vectors.softmax("s")).collect()]
    assert probs[0] == pytest.approx([math.exp(i) / sum(math.exp(j) for j in (1, 2, 3)) for i in (1, 2, 3)])
    assert probs[1] == pytest.approx([0.5, 0.5, 0.0]) and all(sum(p) == pytest.approx(1) for p in probs)
    top = vectors.softmax_top(frame, "s", ["a", "b"]).select("top_index", "label").collect()
    assert [tuple(r) for r in top] == [(2, None), (0, "a")]
    same = vectors.softmax_top(frame.limit(1), "s", ["a", "b", "c"], already_probs=True).first()
    assert same["confidence"] == 3.0 and same["label"] == "c"


def test_sigmoid_labels(spark):
    frame = spark.createDataFrame([([3.0, -3.0, 0.0],), ([-1.0, -1.0, -1.0],)], "s array<double>")
    got = [r["labels"] for r in vectors.sigmoid_labels(frame, "s", ["a", "b", "c"], 0.5).collect()]
    assert got == [["a", "c"], []]


def test_labels(spark):
    names = ["new", "old"]
    frame = spark.createDataFrame([("old", "1"), ("other", "7"), (None, None), ("new", "x"), ("new", "-1")], "n string, k string")
    assert [r["label_id"] for r in labels.encode_labels(frame, "n", names).collect()] == [1, None, None, 0, 0]
    assert [r["label"] for r in labels.decode_labels(frame, "k", names).collect()] == ["old", None, None, None, None]


def test_vectors(spark):
    assert one(spark, vectors.cosine("a", "b"), a=[1.0, 0.0], b=[0.0, 0.0]) is None
    assert one(spark, vectors.l2_distance("a", "b"), a=[1.0, 1.0], b=[4.0, 5.0]) == 5.0
    frame = spark.createDataFrame([(1, [0.1], "t", 3)], "id int, emb array<double>, title string, n int")
    assert vectors.payload_struct(frame, "emb", "id").first()["payload"].asDict() == {"title": "t", "n": 3}
