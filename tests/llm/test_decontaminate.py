import random
import re

from quarrystone.llm import decontaminate as d

SCHEMA = "text string, doc_id long, item_id string"
ITEM = "A train leaves the station with Alice and Bob at 12 km per hour and after 12 minutes Alice has passed 30 trees"


def run(spark, docs, items, **options):
    bench = spark.createDataFrame([(t, i, "clash") for i, t in items], "text string, item_id long, doc_id string")
    return {(r.doc_id, r.item_id): r for r in d.contaminated(spark.createDataFrame(docs, SCHEMA), bench, **options).collect()}


def test_reparameterised_questions(spark):
    filler = " the of and ere thon was in. " * 5
    docs = [
        (filler + ITEM + filler, 1, None),
        (filler + ITEM.replace("Alice", "Carol").replace("12", "45").replace("km", "miles").replace("30", "7.5") + filler, 2, None),
        (filler + ITEM.replace("at 12", "at 45").replace("30", "x") + filler, 3, None),  # 12 stands for 45 and 12
        (ITEM.lower().replace(" ", "\n"), 4, None),
        (filler, 5, None),
        (None, 6, None),
        ("", 7, None),
        (filler * 3000 + ITEM, 8, None),
        (filler + ITEM, 1, "again"),
        (ITEM, None, None),
    ]
    out = run(spark, docs, [(1, ITEM), (2, None), (3, ""), (4, "only four words here")])
    assert (1, 1) in out and out[1, 1].same_slots and out[1, 1].n_slots >= 5
    assert (2, 1) in out and not out[2, 1].same_slots
    assert (8, 1) in out and (3, 1) not in out and not any(k[0] in (5, 6, 7, None) for k in out)
    short = run(spark, [("so only four words here it is", 1, None), ("only four words", 2, None)], [(4, "Only four words here")])
    assert set(short) == {(1, 4)}


def test_literal_windows_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [a + b for a in ("th", "er", "on", "ñi", "sch") for b in ("ea", "ou", "ing", "er", "ion", "é")]
    say = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", "", ",", ".\n", " -"]) for _ in range(n))
    items = [(i, say(rng.randint(3, 40))) for i in range(25)]
    docs = []
    for k in range(120):
        w = rng.choice(items)[1].split(" ")
        a = rng.randint(0, len(w) // 2)
        docs.append((say(rng.randint(0, 60)) + " " + " ".join(w[a : a + rng.randint(0, len(w))]) + " " + say(rng.randint(0, 30)), k, None))
    words = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    for t, k, _ in docs:
        own = words(t)
        for i, item in items:
            w = words(item)
            n, covered = min(8, len(w)), set()
            for p in range(len(w) - n + 1):
                if any(own[q : q + n] == w[p : p + n] for q in range(len(own) - n + 1)):
                    covered |= set(range(p, p + n))
            if len(covered) >= 0.5 * len(w):
                want.add((k, i))
    assert set(run(spark, docs, items)) == want and want


def test_dense_slots_contradictions_and_spacing(spark):
    dense = " , ".join(f"{k} km" for k in range(3, 23)) + " and so on"
    names = "They are " + ", ".join(f"Name{'abcdefghijklmnopqrst'[k]}" for k in range(20))
    words = [a + b for a in ("th", "er", "on", "sch") for b in ("ea", "ou", "ing", "er", "ion", "ain", "ost")] * 2
    words[10], words[40] = "77", "77"
    text = " ".join(words[:56]) + " end"
    docs = [
        ("so " + dense + " he said", 1, None),
        ("so " + dense.replace("km", "miles") + " he said", 2, None),
        ("so " + names + " he said", 3, None),
        (names.lower(), 4, None),
        (text.replace("77", "78", 1), 5, None),
        (ITEM.replace(" ", "\n  "), 6, None),
        (ITEM.lower(), 7, None),
        (ITEM.replace("with ", "with (").replace("and ", "and - "), 8, None),
        ("3 km is far and 4 km is farther still they said to each other on the way", 9, None),
    ]
    out = run(spark, docs, [(1, dense), (2, names), (3, text), (4, ITEM)])
    assert set(out) == {(1, 1), (2, 1), (3, 2), (4, 2), (5, 3), (6, 4), (7, 4), (8, 4)}
    assert out[5, 3].item_words == 57 and out[5, 3].covered == 55 and out[6, 4].same_slots


def test_items_of_one_template_are_a_class(spark):
    names = ["Alice", "Carol", "Dave", "Erin", "Frank", "Grace", "Heidi", "Ivan", "Judy", "Mallory"]
    make = lambda a, b, n, m: ITEM.replace("Alice", a).replace("Bob", b).replace("12", str(n)).replace("30", str(m))
    rng = random.Random(9)
    items = [(i, make(*rng.sample(names, 2), 40 + i, 200 + i)) for i in range(50)]
    filler = " the of and ere thon was in. " * 3
    docs = [(filler + make("Oscar", "Peggy", 500 + k, 900 + k) + filler, k, None) for k in range(100)] + [(filler + items[17][1] + filler, 200, None)]
    bench = spark.createDataFrame([(t, i) for i, t in items], "text string, item_id long")
    classes = d.item_classes(bench, "item_id", "text", 8).collect()
    assert len(classes) == 1 and classes[0].item_id == 0 and len(classes[0].members) == 50
    out = run(spark, docs, items)
    assert set(out) == {(k, 0) for k in [*range(100), 200]} and {r["items"] for r in out.values()} == {50}
    assert out[200, 0].same_slots and not any(out[k, 0].same_slots for k in range(100)) and out[3, 0].n_slots >= 5
    # where slots repeat otherwise, the template is another one
    other = items + [(99, make("Alice", "Bob", 30, 30))]
    assert set(run(spark, docs[:2], other)) == {(0, 0), (1, 0)}
    shared = run(spark, docs[:1], [(5, items[0][1]), (5, "nothing alike in the other text of this id at all")])
    assert set(shared) == {(0, 5)}


def test_empty(spark):
    assert run(spark, [], [(1, ITEM)]) == {} and run(spark, [("a b c", 1, None)], []) == {}
