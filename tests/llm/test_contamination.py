import math
import random

import numpy as np
import pytest

from chunkloom.llm import contamination as ct
from chunkloom.llm.textnorm import Repairer, fold, plain_layout, skeleton

WORDS = [f"{a}{b}" for a in ("lamp", "river", "stone", "cloud", "pepper", "müller", "été", "garden", "silver", "candle") for b in ("", "s", "ing", "ed", "er", "ly")]
SHARED = "Read the text and answer."


def item(seed, n=40):
    rng = random.Random(seed)
    return [rng.choice(WORDS) for _ in range(n)]


def filler(rng, n=60):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def scanner():
    items = [(i, SHARED + "\n" + " ".join(item(i)), True) for i in range(6)] + [(9, " ".join(item(9)), False), (10, "", False), (11, "?!", False)]
    return ct.Scanner(ct.ItemIndex(items))


def found(scanner, text):
    return [leak[0] for leak in scanner.leaks(text) if leak[1] == 0]


def test_whole_half_and_less(scanner):
    rng, w = random.Random(0), item(3)
    doc = lambda part: f"{filler(rng)}\n{' '.join(part)}\n{filler(rng)}"
    assert found(scanner, doc(w)) == [3] and found(scanner, doc(w[10:32])) == [3] and found(scanner, doc(w[:20])) == [3]
    assert found(scanner, doc(w[:15])) == [] and found(scanner, doc([])) == []
    assert found(scanner, doc(item(9) + ["and"] + w)) == [3, 9]


def test_changes_up_to_one_in_five(scanner):
    w = item(2)
    few = [x if i % 7 else "other" for i, x in enumerate(w)]
    more = [y for i, x in enumerate(w) for y in ([x, "added"] if i % 8 == 0 else [x])]
    less = [x for i, x in enumerate(w) if i % 9]
    many = [x if i % 3 else f"other{i}" for i, x in enumerate(w)]
    assert [found(scanner, " ".join(v)) for v in (few, more, less, many)] == [[2], [2], [2], []]


def test_other_order_and_instruction_alone(scanner):
    rng = random.Random(4)
    mixed = item(1)[:]
    rng.shuffle(mixed)
    assert found(scanner, " ".join(mixed)) == [] and found(scanner, SHARED + "\n" + filler(rng)) == []


def test_spelling_layout_markup_and_furniture(scanner):
    w = item(5)
    text = " ".join(w)
    forms = [
        text.upper(), text.replace("é", "é"), text.replace("ü", "ue"), text.encode().decode("cp1252", "replace") if "ü" in text else text,
        " ".join(f"<b>{x}</b>" if i % 3 == 0 else f"_{x}_" for i, x in enumerate(w)), text.replace("er", "e­r"), "\n".join(f"{i}) {' '.join(w[8 * i : 8 * i + 8])}" for i in range(5)),
        "\nHome | News | Help | Login\n".join(" ".join(w[10 * i : 10 * i + 10]) for i in range(4)),
        "\nThis website stores cookies on your device. By continuing you agree. OK / More\n".join(" ".join(w[10 * i : 10 * i + 10]) for i in range(4)),
        text.replace("é", "�").replace("ü", "�"), "&nbsp;".join(w), text.replace("a", "а"),
    ]
    assert [found(scanner, f) for f in forms] == [[5]] * len(forms)


def test_stretches():
    ids = lambda s: np.array([ord(c) for c in s], np.int64)
    assert ct.stretch(ids("abcdefgh"), ids("zzabcdefghzz")) == (8, 0, 2, 9)
    assert ct.stretch(ids("abcdefgh"), ids("abcdXfgh"))[:2] == (7, 1)
    assert ct.stretch(ids("abcdefgh"), ids("abcdeXfgh"))[:2] == (8, 1)
    assert ct.stretch(ids("abcdefgh"), ids("abcdfgh"))[:2] == (7, 1)
    assert ct.stretch(ids("abcdefgh"), ids("abXdXfXh")) is None
    assert ct.stretch(ids("abc"), ids("xyz")) is None and ct.stretch(ids("abc"), ids("abXc")) is None and ct.stretch(ids("abc"), ids("xabcx")) == (3, 0, 1, 3)


def test_words_and_hits_needed():
    assert [ct.words_needed(n) for n in (2, 3, 4, 8, 9, 40)] == [2, 3, 4, 4, 5, 20]
    # no way to break so many words into runs has fewer n-grams
    for n in range(2, 60):
        gram = ct.NGRAM if n > ct.SHORT_ITEM else ct.SHORT_NGRAM
        for fit in range(ct.words_needed(n), n + 1):
            runs = fit // 4 + 1 if n >= ct.LEAST_WORDS else 1
            even = [fit // runs + (k < fit % runs) for k in range(runs)]
            assert sum(max(0, r - gram + 1) for r in even) >= ct.hits_needed(n, gram) >= 1


def changed(rng, words, errors):
    """``words`` with so many of them changed, left out or followed by another one; the first and last stay."""
    out = list(words)
    for at in sorted(rng.sample(range(1, len(words) - 1), errors), reverse=True):
        other = f"other{rng.randrange(10**6)}"
        out[at : at + 1] = rng.choice([[other], [], [out[at], other]])
    return out


@pytest.mark.parametrize("n", [4, 5, 6, 8, 10, 12, 15, 20, 33, 42, 59, 83, 100])
def test_recall_of_partial_copies(n):
    """Stretches of the definition, by construction, in texts of the same words: share 0.5 to 1, up to one word in five changed."""
    rng = random.Random(n)
    common = [f"w{i}" for i in range(300)]
    found = wrong = 0
    total = 60
    items = [(i, " ".join(rng.choice(common) for _ in range(n)), False) for i in range(total)]
    own = ct.Scanner(ct.ItemIndex(items))
    for i, text, _ in items:
        words = text.split()
        size = max(ct.words_needed(n), rng.randint(math.ceil(n / 2), n))
        while True:  # at most one error to four words that fit
            errors = rng.randint(0, size // 5)
            if errors + 2 <= size and size - errors >= max(ct.words_needed(n), 4 * errors):
                break
        start = rng.randint(0, n - size)
        part = changed(rng, words[start : start + size], errors)
        around = [rng.choice(common) for _ in range(60)]
        got = {leak[0] for leak in own.leaks(" ".join(around[:30] + part + around[30:]))}
        found += i in got
        wrong += len(got - {i})
    assert found >= (0.97 if n >= 10 else 0.9) * total and (n < 10 or wrong <= 2)


def test_short_items():
    own = ct.Scanner(ct.ItemIndex([(1, "Quantum flux capacitor", False), (2, "Paris", False), (3, "red fox", False), (4, "one two three four five six seven eight", False)]))
    assert found(own, "They built a quantum FLUX capacitor in Paris.") == [1] and found(own, "quantum flux of a capacitor") == [] and found(own, "A red fox.") == [3]
    assert found(own, "so one two other four five then") == [4] and found(own, "one two three") == []


def test_every_copy_comes_out_and_is_cut(scanner):
    w = " ".join(item(3))
    text = f"start here. {w}\nbetween. {w} {w}\n\n{filler(random.Random(1), 200)}\n{' '.join(item(3)[5:30])} end here."
    got = [leak for leak in scanner.leaks(text) if leak[0] == 3]
    assert [leak[1] for leak in got] == [0, 1, 2, 3] and [leak[2] for leak in got] == [40, 40, 40, 25]
    left = scanner.without(text)
    assert scanner.leaks(left) == [] and left.split()[:2] == ["start", "here."] and left.split()[-2:] == ["end", "here."] and "between." in left
    # what is left of a stretch and its neighbour must not make up another one
    rng = random.Random(3)
    for _ in range(40):
        parts = []
        for _ in range(4):
            start = rng.randrange(30)
            parts += [item(3)[start : start + rng.randrange(8, 40)], filler(rng, rng.randrange(1, 20)).split()]
        rest = scanner.without(text := " ".join(x for p in parts for x in p))
        assert rest is None or scanner.leaks(rest) == [], text


def test_tables(spark):
    text = " ".join(item(1))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, None, "x"), (3, "", "x"), (4, "z " * 300_000, "x"), (5, "q" * 100_000, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(7, text), (8, None), (9, ""), (10, text)], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in ct.find_leaks(docs, items).where("nr = 0").collect())
    assert got == [(1, 7), (1, 7), (1, 10), (1, 10)]
    assert sorted((r["doc_id"], r["item_id"]) for r in ct.find_leaks(docs, items, most=150).where("nr = 0").collect()) == got
    assert ct.find_leaks(docs.limit(0), items).count() == 0 and ct.find_leaks(docs, items.limit(0)).count() == 0


def test_cutting_out(spark):
    text = " ".join(item(1))
    docs = spark.createDataFrame([(1, f"before it. {text} after it."), (2, "clean")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, text)], "item_id bigint, text string")
    for most in (ct.ITEM_BYTES, 200):
        got = ct.without_leaks(docs, items, most)
        assert [(r["doc_id"], r["text"].split()) for r in got.collect()] == [(1, ["before", "it.", "after", "it."])]
        assert ct.find_leaks(got, items).count() == 0


def test_shared_instructions(spark):
    data = [(1, "Read.\nfirst rest"), (2, "  Read. \nsecond rest"), (3, "Alone.\nthird"), (4, "Alone.\nthird"), (5, "Read."), (6, None)]
    got = {r["item_id"]: r["shared"] for r in ct.with_shared(spark.createDataFrame(data, "item_id bigint, text string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}


def test_repair_and_fold():
    repair = Repairer()
    good = ["Gärtner über Straße", "été à l’école", "dróżnik głośny", "Дорогой человек", "plain", "naïve café №5"]
    assert [repair(t) for t in good] == good
    for charset, texts in (("cp1252", good[:2]), ("latin-1", good[:2]), ("cp1250", [good[2]])):
        for t in texts:
            raw = t.encode()
            try:
                damaged = raw.decode(charset)
            except UnicodeDecodeError:
                continue
            assert repair(damaged) == t
    assert repair("нашёл".encode("koi8-r").decode("latin-1")) == "нашёл" and repair("żałosny jesienią".encode("iso8859-2").decode("latin-1")) == "żałosny jesienią"
    assert repair("żałosny jesienią".encode("cp1250").decode("cp1252")) == "żałosny jesienią" and repair("5 m² ±3") == "5 m² ±3" and repair("¿Cuándo? œuvre") == "¿Cuándo? œuvre"
    assert repair("Äîðîãîé ÷åëîâåê") == "Дорогой человек"
    assert fold("Müller") == fold("MUELLER") == fold("müller") == "muller" and fold("ﬁsh") == "fish" and fold("tenant’s") == "tenants" and fold("Łódź") == "lodz"
    assert fold("сlоwn") == "clown" and fold("слон") == "слон" and skeleton("camión") == "camin" and plain_layout("a<br>b &amp; fro-\nmage") == "a b & fromage"
