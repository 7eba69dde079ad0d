from __future__ import annotations

import pytest

from kindred.llm import decontaminate, queries
from tests.llm.conftest import SF, wide

ITEM = ("Every morning Tom buys 12 apples and sells 5 of them at the market for 3 dollars each before he walks home "
        "along the river with the money in his pocket")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, ITEM), (2, "What is it called when plants turn light into sugar?"), (3, None), (4, "1 2 3 4 5 6 7 8 9"), (5, "")],
        "item_id long, text string")


def found(spark, items, text, **options):
    docs = wide(spark, [(10, text)])
    return {r.item_id: r for r in decontaminate.contaminated(docs, items, **options).collect()}


def test_query_finds_the_planted_items(spark, docs):
    import duckdb
    items = duckdb.connect().execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = {(d, i) for d, t in docs for i, item in items if item in (t or "")}
    assert want and {(r.doc_id, r.item_id) for r in queries.op1_decontaminate(spark, SF).collect()} == want


def test_whole_and_reparameterised_questions(spark, items):
    same = found(spark, items, f"Some words before it. {ITEM}. And after.")
    assert set(same) == {1} and not same[1].reparameterised and same[1].coverage == 1
    other = ITEM.replace("Tom", "Anna").replace("12", "40").replace(" 5 ", " 9 ").replace("3 dollars", "7 euros")
    got = found(spark, items, f"Read this: {other}. Next.")
    assert got[1].reparameterised and got[1].consistency == 1


def test_inconsistent_slots_do_not_match(spark, items):
    item = "then Ann meets Bob near here while Ann thanks Bob and later Ann asks Bob whether Ann may visit Bob again"
    one = spark.createDataFrame([(1, item)], "item_id long, text string")
    exchanged = item.replace("Ann", "Eva").replace("Bob", "Max")
    assert set(found(spark, one, exchanged)) == {1}
    names = iter("Ida Leo Mia Tim Zoe Jan Eli Kai".split())
    mixed = " ".join(next(names) if w in ("Ann", "Bob") else w for w in item.split())
    assert not found(spark, one, mixed)


def test_short_items_and_clean_texts(spark, items):
    assert set(found(spark, items, "So: what is it called when plants turn light into sugar? Indeed")) == {2}
    assert not found(spark, items, "1 2 3 4 5 6 7 8 9 10 11 12")
    assert not found(spark, items, "Tom buys 12 apples. " * 50)
    # A passage shorter than the asked share of the item.
    assert not found(spark, items, " ".join(ITEM.split()[:12]))


def test_verbatim_copies_in_any_case_and_script(spark, items):
    for text in (ITEM.upper(), ITEM.lower(), ITEM.title()):
        got = found(spark, items, f"Before it. {text}. After.")
        assert set(got) == {1} and got[1].coverage == 1 and not got[1].reparameterised
    own = spark.createDataFrame(
        [(1, "3 14 15 92 65 35 89 79 32 38 46"), (2, "Otto Hahn, Lise Meitner, Max Planck, Marie Curie, Niels Bohr"),
         (3, "小明有3个苹果，卖了2个，又买了5个，现在他一共有几个苹果？"), (4, "Große Straße"), (5, "Alone")],
        "item_id long, text string")
    for item, text in ((1, "pi: 3 14 15 92 65 35 89 79 32 38 46 and so on"),
                       (2, "They were OTTO HAHN, LISE MEITNER, MAX PLANCK, MARIE CURIE, NIELS BOHR."),
                       (3, "请看题目：小明有3个苹果，卖了2个，又买了5个，现在他一共有几个苹果？答案是六。"), (4, "DIE GROSSE STRASSE")):
        got = found(spark, own, text)
        assert set(got) == {item} and got[item].coverage == 1
    assert not found(spark, own, "3 14 15 92 6 5 3 5 8 9 7 Otto Alone 小明有很多苹果")


def test_each_copy_of_a_document_is_judged_alone(spark, items):
    def variant(name, *numbers):
        new = iter(numbers)
        return " ".join(name if w == "Tom" else next(new) if w.isdigit() else w for w in ITEM.split())

    one, two = variant("Anna", "40", "9", "7"), variant("Otto", "31", "8", "6")
    alone = found(spark, items, one)[1]
    assert alone.coverage == alone.consistency == 1 and alone.reparameterised
    for text in (f"{one}. {two}.", f"First: {one}. Much more text stands in between. Then: {two}.", f"{one} {two} {one}"):
        assert found(spark, items, text)[1] == alone
    both = found(spark, items, f"{ITEM}. Or so: {one}.")
    assert both[1].coverage == both[1].consistency == 1 and not both[1].reparameterised
    # A template that stands twice in the item itself.
    item = "Tom likes the red apples and eats them all day long . Ann likes the red apples and eats them all day long"
    twice = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert set(found(spark, twice, item.replace("Tom", "Eva").replace("Ann", "Max"))) == {1}


def test_canonical_tokens():
    assert [decontaminate.canonical(w)[0] for w in ("12,5", "$3", "Tom's", "kg", "5kg", "(the", "--", "A", "7th")] == [
        "<number>", "<number>", "<name>", "<unit>", "<quantity>", "the", "--", "a", "<number>"]


def test_edges(spark, edge, none, items):
    assert decontaminate.contaminated(edge, items).count() == 0
    assert decontaminate.contaminated(none, items).count() == 0
    assert decontaminate.contaminated(edge, items.where("item_id < 0")).count() == 0
    assert decontaminate.clean(none, items).count() == 0
    rows = wide(spark, [(1, ITEM), (1, ITEM), (None, ITEM), (None, "clean text"), (1, "clean text"), (2, None)])
    out = decontaminate.clean(rows, items)
    assert out.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted(
        [(None, "clean text"), (1, "clean text"), (2, None)], key=repr)


def plainly(docs, items, size=8, coverage=0.5, consistency=0.75):
    """Coverage and consistency of whole documents, by comparing every pair of windows; for texts without two copies."""
    def words(text):
        return [w for w in text.split() if decontaminate.canonical(w)[0]]

    out = {}
    for item_id, item in items:
        wanted = words(item)
        length = min(size, len(wanted))
        for doc_id, text in docs:
            held = words(text)
            for plain in (False, True):
                def form(ws, plain=plain):
                    return [w.strip(decontaminate.PUNCTUATION).casefold() if plain else decontaminate.canonical(w)[0] for w in ws]

                def places(ws, plain=plain):
                    every = range(len(ws) - length + 1)
                    return [i for i in every if plain or sum(
                        not t.startswith("<") for t in form(ws[i:i + length])) >= max(2, 0.4 * length)]

                mine = {i: form(wanted[i:i + length]) for i in places(wanted)}
                met = [(i, j) for j in places(held) for i, f in mine.items() if form(held[j:j + length]) == f]
                if not mine or len({i for i, _ in met}) < coverage * len(mine):
                    continue
                pairs = {((k := decontaminate.canonical(a))[0], k[1], decontaminate.canonical(b)[1]) for i, j in met
                         for a, b in zip(wanted[i:i + length], held[j:j + length]) if decontaminate.canonical(a)[0].startswith("<")}
                agree = 1.0 if plain or not pairs else min(
                    len({p[:2] for p in pairs}), len({(p[0], p[2]) for p in pairs})) / len(pairs)
                if agree >= consistency:
                    old = out.get((doc_id, item_id), (0, 0))
                    out[doc_id, item_id] = max(old[0], len({i for i, _ in met}) / len(mine)), max(old[1], agree)
    return out


def test_random_templates_equal_a_plain_comparison(spark):
    import random
    rng = random.Random(11)
    literal = [f"{a}{b}" for a in "bdfgk" for b in ("ale", "ori", "une")]
    names, numbers = ["Ann", "Bob", "Cleo", "Dan", "Eve"], ["3", "14", "159", "26"]

    def item():
        return [rng.choice(literal if rng.random() < 0.6 else names if rng.random() < 0.6 else numbers) for _ in range(rng.randint(6, 30))]

    def changed(words):
        swap = {w: rng.choice(names if w in names else numbers) if rng.random() < 0.4 else w for w in names + numbers}
        new = [swap.get(w, w) for w in words]
        if rng.random() < 0.3:
            new = [rng.choice(names) if w in names else w for w in new]
        start = rng.randint(0, len(new) // 2)
        return new[start:] if rng.random() < 0.4 else new

    items = [(i, " ".join(item())) for i in range(12)]
    texts = []
    for d in range(60):
        filler = [f"z{rng.randint(0, 99)}y" for _ in range(rng.randint(0, 30))]
        texts.append((d, " ".join([*filler, *changed(rng.choice(items)[1].split()), "...", *filler[:5]])))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(
        wide(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = plainly(texts, items)
    # What passes as a whole document is found with at least these values; what is found beyond that is a stretch that passes.
    assert set(want) <= set(got) and len(want) > 20
    assert all(got[k].coverage >= v[0] - 1e-12 and got[k].consistency >= v[1] - 1e-12 for k, v in want.items())
    loose = plainly(texts, items, consistency=0.0)
    assert all(got[k].coverage <= loose[k][0] + 1e-12 for k in got) and set(got) <= set(loose)
