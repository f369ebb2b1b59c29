import random

import pytest

from lakeloom.llm import decontamination as d

ITEM = "A train with 12 wagons leaves Berlin at 9:30 and travels 240 km towards Hamburg while Anna waits 3 hours for the train in Hamburg and then counts 12 red wagons."
OTHER = "A train with 15 wagons leaves Madrid at 8:10 and travels 310 miles towards Toledo while Carla waits 4 hours for the train in Toledo and then counts 15 red wagons."
WRONG = "A train with 15 wagons leaves Madrid at 8:10 and travels 310 miles towards Toledo while Carla waits 4 hours for the train in Madrid and then counts 19 red wagons."
FILL = "nothing of this text has anything to do with any question at all and it simply goes on and on until it stops being read by anyone. "


@pytest.mark.parametrize("word,want", [
    ("12", ("num", "12")), ("$1,200.50,", ("num", "1,200.50")), ("5km.", ("quantity", "5km")), ("km", ("unit", "km")), ("(Hours)", ("unit", "hours")),
    ("Anna's", ("name", "anna's")), ("WORLD!!", ("word", "world")), ("the***", ("word", "the")), ("***", ("", "")), ("A", ("name", "a")), ("3rd", ("num", "3rd")), ("été,", ("word", "été")),
])
def test_template_tokens(word, want):
    assert d.template_token(word) == want


def run(spark, docs, items, monkeypatch=None):
    out = d.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r["doc_id"], tuple(r["items"])) for r in out.collect() if r["contaminated"]}, out.count()


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_copies_and_new_parameters_are_found(spark, monkeypatch, bound):
    monkeypatch.setattr(d, "FILTER_HASHES", bound)
    docs = [(1, FILL + ITEM + " " + FILL), (2, FILL * 3), (3, FILL + OTHER), (4, FILL + WRONG), (5, ITEM.replace(" ", "*** ")), (6, ITEM.split(" while")[0]), (7, None), (8, ""), (1, FILL + ITEM + " " + FILL), (None, ITEM), (9, FILL + ITEM.replace("red", "red and blue"))]
    items = [(10, ITEM), (11, None), (12, ""), (13, "too short"), (None, FILL), (14, "one window of five words")]
    found, n = run(spark, docs, items)
    assert n == len(docs)
    assert found == {(1, (10,)), (3, (10,)), (5, (10,)), (None, (10,)), (9, (10,))}


def test_planted_items(spark, small_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = {r["doc_id"]: set(r["items"]) for r in d.contamination(small_docs, items).collect()}
    texts = {r["item_id"]: r["text"] for r in items.collect()}
    want = {r["doc_id"]: {i for i, t in texts.items() if t in (r["text"] or "")} for r in small_docs.collect()}
    assert rows == want
    assert set(r["doc_id"] for r in d.drop_contaminated(small_docs, items).collect()) == {k for k, v in want.items() if not v}


def test_edges(spark, edge_docs, no_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert d.contamination(edge_docs, items).where("contaminated").count() == 0
    assert d.drop_contaminated(edge_docs, items).count() == edge_docs.count()
    assert d.contamination(no_docs, items).count() == 0
    assert d.contamination(edge_docs, items.limit(0)).where("not contaminated").count() == edge_docs.count()


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_copies_in_another_letter_case_are_found(spark, monkeypatch, bound):
    monkeypatch.setattr(d, "FILTER_HASHES", bound)
    named = "Please ask Anna Berg Carla Dahl and Emil Frank whether Gerda Holm Ivar Jansen or Karl Lund will visit Maria Nyborg and Otto Poulsen in Straße Roma."
    docs = [(1, FILL + named.upper() + " " + FILL), (2, FILL + named.lower()), (3, named), (4, FILL + named.swapcase()), (5, FILL + " ".join(named.upper().split()[::-1]))]
    assert run(spark, docs, [(10, named)])[0] == {(1, (10,)), (2, (10,)), (3, (10,)), (4, (10,))}


def test_copies_of_items_rich_in_numbers_and_names_are_found(spark):
    sums = "Compute 12 + 35 km minus 7 kg times 81 divided by 9 hours plus 44 miles minus 3 percent of 250 dollars for Anna."
    other = "Compute 11 + 39 km minus 6 kg times 80 divided by 4 hours plus 43 miles minus 2 percent of 251 dollars for Anna."
    found, _ = run(spark, [(1, FILL + sums), (2, FILL + sums.upper()), (3, FILL + other), (4, FILL)], [(10, sums)])
    assert found == {(1, (10,)), (2, (10,)), (3, (10,))}


def test_scripts_without_blanks_are_checked(spark):
    chinese, thai, japanese = "一列火车从北京出发以每小时八十公里的速度开往上海需要几个小时", "รถไฟออกจากกรุงเทพไปเชียงใหม่ใช้เวลากี่ชั่วโมง", "東京から大阪まで列車で何時間かかりますか？"
    fill = "今天的天气很好我们去公园散步然后回家吃饭"
    docs = [(1, fill + chinese + "。" + fill), (2, fill + thai), (3, FILL + japanese + "すごい"), (4, fill * 5), (5, chinese[:12] + fill), (6, "ประเทศไทย")]
    assert run(spark, docs, [(10, chinese), (11, thai), (12, japanese), (13, "ประเทศ"), (14, "天气")])[0] == {(1, (10,)), (2, (11,)), (3, (12,))}


@pytest.mark.parametrize("bound", [4_000_000, 0])
def test_short_items_are_found_as_whole_sentences_or_lines(spark, monkeypatch, bound):
    monkeypatch.setattr(d, "FILTER_HASHES", bound)
    docs = [
        (1, "What is gravity?"), (2, "what IS Gravity"), (3, "what is gravity now"), (4, FILL + "What is gravity?"), (5, "天气"), (6, "天气很"), (7, FILL + "\nwhat is gravity\n" + FILL), (8, FILL + "so what is gravity? " + FILL),
        (9, f'{FILL}He asked: "What is GRAVITY?" and {FILL}'), (10, "很好。天气。今天很好我们去公园散步"), (11, FILL + "What is 2 + 2? " + FILL), (12, FILL + "we know what is 2 + 2? " + FILL), (13, "No. What is gravity?"), (14, FILL + "***\n"),
    ]
    items = [(10, "What is gravity?"), (11, "天气"), (12, "***"), (13, ""), (14, "What is 2 + 2?")]
    assert run(spark, docs, items)[0] == {(1, (10,)), (2, (10,)), (4, (10,)), (5, (11,)), (7, (10,)), (9, (10,)), (10, (11,)), (11, (14,)), (13, (10,))}


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, ITEM, "x", "y", "z"), (2, FILL, "x", "y", "z")], "doc_id long, text string, row string, _row string, items string")
    items = spark.createDataFrame([(10, ITEM, "x")], "item_id long, text string, row string")
    left = d.drop_contaminated(docs, items)
    assert left.columns == docs.columns and [(r["doc_id"], r["row"], r["_row"]) for r in left.collect()] == [(2, "x", "y")]
    assert sorted((r["doc_id"], r["contaminated"]) for r in d.contamination(docs, items).collect()) == [(1, True), (2, False)]


def plain_leak(text, item, window=8):
    """Whether an item leaks into a text, by plain comparison of every shift and window."""
    tokens = lambda t: [x for x in map(d.template_token, t.split()) if x[0]]
    a, b = tokens(item), tokens(text)
    size, kind = min(window, len(a)), lambda x: x[1] if x[0] == "word" else f"<{x[0]}>"
    if len(a) < d.LITERALS:
        return [v for _, v in a] == [v for _, v in b] and bool(a)
    covered = set()
    for shift in range(-len(a), len(b)):
        typed, literal = [], []
        for at in range(len(a) - size + 1):
            x, y = a[at : at + size], b[at + shift : at + shift + size] if at + shift >= 0 else []
            if len(y) == size and list(map(kind, x)) == list(map(kind, y)) and any(k == "word" for k, _ in x):
                typed.append(at)
            if [v for _, v in x] == [v for _, v in y]:
                literal.append(at)
        inside = {at + k for at in typed for k in range(size)}
        slots = {(a[i], b[i + shift]) for i in inside if a[i][0] != "word"}
        if len({x for x, _ in slots}) == len({y for _, y in slots}) == len(slots) and sum(a[i][0] == "word" for i in inside) >= d.LITERALS:
            covered |= inside
        covered |= {at + k for at in literal for k in range(size)}
    return len(covered) >= d.COVERED * len(a)


def test_leaks_equal_those_of_a_plain_aligner(spark):
    rnd = random.Random(6)
    words = "alpha beta gamma delta Anna Berta Carl 3 17 km hours red blue of the and".split()
    items = [(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([2, 4, 6, 9, 14, 25])))) for k in range(25)]
    other = {"Anna": "Maria", "3": "8", "km": "miles"}
    docs = []
    for n in range(150):
        own = rnd.choice(items)[1].split()
        if n % 3 == 0:
            own = [other.get(w, w) for w in own]
        if n % 4 == 0:
            own[rnd.randrange(len(own))] = rnd.choice(words)
        if n % 5 == 0:
            own = [w.upper() for w in own]
        docs.append((n, " ".join([rnd.choice(words) for _ in range(n % 7)] + own + [rnd.choice(words) for _ in range(n % 3)])))
    want = {n: tuple(k for k, item in items if plain_leak(text, item)) for n, text in docs}
    assert run(spark, docs, items)[0] == {(n, own) for n, own in want.items() if own} and 20 < sum(map(bool, want.values()))
