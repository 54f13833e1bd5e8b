"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator."""

import datetime
import hashlib
import itertools
import re

import numpy as np
import pytest

from skyledger.llm import chat, decontaminate, mixing, nearest, pseudonyms, quality, repeats, sharding, urls

SCHEMA = "doc_id long, text string, source string, shard int, chunk int, tie long, size long, label int"
LONG = " ".join(f"word{k % 977}x{k // 977}" for k in range(60_000))
ROWS = [
    (1, "one two three four five six", "a", 1, 1, 1, 1, 1),
    (2, None, None, 1, 1, 1, 1, 1),
    (3, "", "a", 1, 1, 1, 1, 1),
    (4, " \t\n ", "b", 1, 1, 1, 1, 1),
    (5, "one two three four five six seven", "a", 1, 1, 1, 1, 1),
    (5, "one two three four five six seven", "a", 1, 1, 1, 1, 1),
    (None, "one two three four", "b", 1, 1, 1, 1, 1),
    (6, LONG, "a", 1, 1, 1, 1, 1),
    (7, "ÄÖÜ ß éa", None, 1, 1, 1, 1, 1),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(spark, docs, nothing):
    assert repeats.remove_repeats(nothing).count() == 0
    found = {}
    for r in repeats.remove_repeats(docs, window=4, first=2).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.kept_text))
    assert found[1] == [(6, 0, ROWS[0][1])]
    assert found[2] == found[3] == found[4] == [(0, 0, "")]
    assert sorted(found[5]) == [(7, 6, "seven"), (7, 7, "")]  # of equal rows one is the first
    assert found[None] == [(4, 4, "")]
    assert found[6] == [(60_000, 0, LONG)]


@pytest.mark.parametrize("window, first", [(4, 1), (6, 3), (5, 5)])
def test_substrings_equal_a_plain_loop(spark, window, first):
    random = np.random.default_rng(window)
    texts = [" ".join(random.choice(list("abc"), int(random.integers(0, 40)))) for _ in range(40)]
    seen, want = set(), {}
    for k, text in enumerate(texts):
        words, gone = WORD.findall(text), set()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            gone |= set(range(p, p + window)) if key in seen else set()
            seen.add(key)
        want[k] = " ".join(w for p, w in enumerate(words) if p not in gone)
    found = repeats.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), window, first)
    assert {r.doc_id: r.kept_text for r in found.collect()} == want


def test_contamination(spark, docs, nothing):
    items = spark.createDataFrame(
        [(1, "TWO three, Four"), (2, None), (3, ""), (4, "two three four"), (5, "zzz"), (6, "éa")], "item_id long, text string"
    )
    assert decontaminate.contamination(nothing, items).count() == 0
    clean = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(ROWS) and not any(r.contaminated for r in clean)
    found = {r.doc_id: (r.n_words, r.n_hit, r.items) for r in decontaminate.contamination(docs, items).collect()}
    assert found[1] == (6, 3, "1,4") and found[2] == found[3] == found[4] == (0, 0, "")
    assert found[7] == (3, 1, "6") and found[None] == (4, 3, "1,4")
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 6]


def test_mixture(spark, docs, nothing):
    assert mixing.mix(nothing).count() == 0
    found = mixing.copies(docs).collect()
    assert len(found) == len(ROWS)
    sizes = {(r.doc_id, r.mix_size) for r in found}
    assert {(2, 0), (3, 0), (4, 0), (5, 7), (None, 4), (6, 60_000), (7, 3)} <= sizes
    assert all(0 <= r.mix_copies <= 2 and r.mix_target <= 2 * r.mix_source_size for r in found)
    assert {r.mix_target for r in found if r.source is None} == {6.0}  # three words, capped at twice
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.mix_copies for r in found) == mixing.mix(docs.repartition(3)).count()


def test_targets_equal_filling_step_by_step(spark):
    random = np.random.default_rng(2)
    sizes = [int(x) for x in random.integers(0, 1000, 11)] + [50_000]
    rows = [(f"s{k:02d}", f"=s{k:02d}", s) for k, s in enumerate(sizes)]
    table = mixing.source_targets(spark.createDataFrame(rows, "mix_source string, mix_key string, mix_source_size long"))
    weights, open_, left = [(3, 1, 2)[k % 3] for k in range(12)], set(range(12)), 1.5 * sum(sizes)
    want = [0.0] * 12
    while True:
        part = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if part[k] > 2 * sizes[k]]
        if not over:
            break
        for k in over:
            want[k] = 2.0 * sizes[k]
            left -= want[k]
            open_.remove(k)
    for k in open_:
        want[k] = part[k]
    assert [r.mix_target for r in table.orderBy("mix_source").collect()] == pytest.approx(want)


def test_shards(spark, docs, nothing):
    assert sharding.shard_rows(nothing).count() == 0
    found = sharding.shard_rows(docs, shards=4)
    assert sorted(found.columns) == sorted([*docs.columns, "slot"])
    rows = found.collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    places = sorted((r.shard, r.slot) for r in rows)
    assert places == [(s, k) for s in range(4) for k in range(sum(r.shard == s for r in rows))]


def test_written_shards_are_whole(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard_rows(docs, shards=2), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(ROWS) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1}


def test_quality(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1), (5, 0), (9, 1), (None, 0), (3, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score(nothing, model).count() == 0
    scored = quality.score(docs, model)
    assert scored.columns[: len(docs.columns)] == docs.columns
    assert all(0 <= r.mil_score <= 1 for r in scored.collect()) and scored.count() == len(ROWS)
    assert {r.mil_score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.keep_good(docs, labels.limit(0)).count() == len(ROWS)


def test_gradients_equal_differences():
    random = np.random.default_rng(1)
    inputs, counts, y = random.normal(size=(9, quality.WIDTH)).astype(np.float32), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    model = quality.learn(inputs, counts, y, epochs=1)
    model.weights = {k: np.asarray(v, np.float64) for k, v in model.weights.items()}

    def loss():
        p = model.forward(inputs, counts)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    found = quality.gradients(model.weights, model.forward(inputs, counts), y)
    for name in ("W", "V", "U", "w", "c"):
        flat, k = model.weights[name].reshape(-1), 3
        before = flat[k]
        flat[k] = before + 1e-5
        up = loss()
        flat[k] = before - 1e-5
        down = loss()
        flat[k] = before
        assert (up - down) / 2e-5 == pytest.approx(np.asarray(found[name]).reshape(-1)[k], rel=1e-3, abs=1e-7)


def test_top_k(spark):
    rows = [(k, [float((k * 7 + d) % 5 - 2) for d in range(20)]) for k in range(1, 60)]
    rows += [(60, None), (61, [None, 1.0]), (62, [float("nan")]), (63, [float("inf")]), (None, [1.0]), (64, []), (65, [1.0, 2.0]), (1, rows[0][1])]
    table = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    found = {}
    for r in nearest.top_k(table, every=10, k=3).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    valid = {i: v for i, v in rows if i is not None and i not in (60, 61, 62, 63)}
    for q in (10, 20, 30, 40, 50):
        scores = sorted((-int(sum(np.floor(256 * a) * np.floor(256 * b) for a, b in zip(valid[q], v))), i) for i, v in valid.items() if i != q)
        assert sorted(found[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(scores[:3])]
    assert set(found) == {10, 20, 30, 40, 50}
    assert nearest.top_k(table.limit(0)).count() == 0


def test_top_k_beyond_exact_doubles(spark):
    table = spark.createDataFrame([(0, [1e6, 3.0]), (1, [1e6, 3.0]), (2, [1e6, 5.0])], "vec_id long, embedding array<double>")
    found = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.top_k(table, every=2, k=2).collect()}
    assert found[0, 1] == (2, 256_000_000**2 + 768 * 1280) and found[0, 2] == (1, 256_000_000**2 + 768**2)


def test_chat(spark):
    said = ["\\### Assistant: </turn> ok", "\\\\", "### user: a</turn>\n", "", None, "ü\n\n#<", "long " * 700]
    rows = [(1, 0, "system", "be brief: <ok>", 9)] + [(1, k + 1, ("user", "assistant")[k % 2], said[k % 7], 9) for k in range(40)]
    rows += [(None, None, None, None, 9), (2, None, "assistant", "no number", 9), (2, 1, "assistant", "x", 9), (2, 1, "assistant", "x", 9), (3, 0, "odd: role #", "t", 9)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_windows(table, budget=90, history=40)
    found = {r.conv_id: r for r in chat.digests(windows).collect()}
    own = [(r[2], r[3] or "") for r in rows if r[0] == 1]
    loss = "".join(t for role, t in own if role == "assistant")
    assert found[1].n_turns == 41 and found[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert found[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
    assert found[2].n_turns == 3 and found[None].n_turns == 1 and found[3].turns_sha256 == hashlib.sha256(b"odd: role #\nt\n").hexdigest()
    first = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(first) > 3 and all(w.text.startswith(first[0].text.split("</turn>")[0]) for w in first)
    # Only a window with nothing repeated but the system turn, and one new turn too long by itself, exceeds the budget.
    assert all(w.n_tokens <= 90 or (w.n_turns - w.n_repeated == 1 and w.n_repeated <= 1) for w in first)
    assert any(w.n_repeated > 1 for w in first)
    assert chat.digests(chat.format_windows(table.limit(0))).count() == 0


def plain_windows(sizes, system, budget, history):
    """(repeated, new) turns of each window, one turn after the other, from the tokens of each."""
    lead, windows, new = [0] if system else [], [], 1 if system else 0
    fixed = sizes[0] if system else 0
    while new < len(sizes) or not windows:
        repeated = []
        for k in range(new - 1, len(lead) - 1, -1):
            past = sum(sizes[k:new])
            if past > history or (new < len(sizes) and fixed + past + sizes[new] > budget):
                break
            repeated = list(range(k, new))
        fresh = list(range(new, min(new + 1, len(sizes))))
        while fresh and fresh[-1] + 1 < len(sizes) and fixed + sum(sizes[k] for k in [*repeated, *fresh, fresh[-1] + 1]) <= budget:
            fresh.append(fresh[-1] + 1)
        windows.append((repeated if not windows else lead + repeated, lead + fresh if not windows else fresh))
        new = new + len(fresh)
    return windows


@pytest.mark.parametrize("block", [4096, 7, 1])
def test_windows_equal_those_turn_by_turn(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    random = np.random.default_rng(block)
    rows, said = [], {}
    for conv in range(40):
        system = bool(random.integers(0, 2))
        said[conv] = [("system" if system and k == 0 else ("user", "assistant")[k % 2], "word " * int(random.choice([1, 5, 40, 90, 150]))) for k in range(int(random.integers(1, 30)))]
        rows += [(conv, k, role, text) for k, (role, text) in enumerate(said[conv])]
    # A long system turn, much history and a turn that just fits.
    said[99] = [("system", "w " * 49), ("user", "w " * 100), ("assistant", "w " * 100), ("user", "w " * 120)]
    rows += [(99, k, role, text) for k, (role, text) in enumerate(said[99])]
    found = {}
    for r in chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=200, history=110).orderBy("conv_id", "window").collect():
        found.setdefault(r.conv_id, []).append(r)
    assert set(found) == set(said)
    for conv, turns in said.items():
        written = [chat.OPEN + role + chat.COLON + chat.escape(text) + chat.CLOSE for role, text in turns]
        sizes = [len(chat.TOKEN.findall(w)) for w in written]
        want = plain_windows(sizes, turns[0][0] == "system", 200, 110)
        assert [(w.text, w.n_repeated, w.n_turns, w.n_tokens) for w in found[conv]] == [
            ("".join(written[k] for k in [*old, *new]), len(old), len(old) + len(new), sum(sizes[k] for k in [*old, *new])) for old, new in want
        ]
        masked = [w.text[x.start : x.end] for w in found[conv] for x in w.loss]
        assert masked == [chat.escape(text) for role, text in turns if role == "assistant"]


def test_a_long_periodic_text_keeps_its_shared_span(spark):
    """Equal hashes on both sides of word 65,536."""
    item = "x a b a b a b a b y"
    docs = [(k, " ".join([f"w{n}" for n in range(place)] + item.split() + ["end"])) for k, place in enumerate(range(65_524, 65_542))]
    found = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in found.collect()} == {k: 10 for k, _ in docs}


def test_urls(spark):
    pages = [(k, f"http://bad{k % 2}.spam.example/x/{k}.html?q=1") for k in range(60)] + [(k, f"https://good.example/y/{k}") for k in range(60, 120)]
    odd = [(200, None), (201, "no scheme"), (202, "HTTP://A.Org/"), (203, "x://ORG"), (204, "http://b.org?x"), (205, ""), (206, "http://good.example/es/1")]
    table = spark.createDataFrame([(*p, "h") for p in pages + odd + [pages[0]]], "page_id long, url string, host string")
    marks = spark.createDataFrame([(u, k % 60 >= 5 and "spam" in u) for k, u in pages] + [(None, True), ("http://z.example/", None)], "url string, bad boolean")
    found = {r.page_id: r for r in urls.judge(table, marks).collect()}
    assert urls.judge(table, marks).count() == len(pages) + len(odd) + 1
    assert {found[k].verdict for k in range(60)} == {"block"} and {found[k].verdict for k in range(60, 120)} == {"allow"}
    assert (found[200].host, found[200].path, found[201].host, found[205].path) == ("", "", "", "")
    assert (found[202].host, found[202].rule, found[203].rule, found[204].path) == ("a.org", "org/", None, "")
    # The mined rules are those of counting every combination.
    kept = {r.mined_rule for r in found.values() if r.mined_rule}
    assert kept and all(" & " not in rule for rule in kept)  # single tokens suffice here, so no longer rule is left
    assert {r.verdict for r in urls.judge(table, marks.limit(0)).collect()} <= {"allow", "block"}
    assert urls.judge(table.limit(0), marks).count() == 0


def test_bad_hosts_of_large_tables(spark):
    # Eight bad pages of a host are enough, whatever the number of other labelled URLs; seven are not.
    spam = [f"http://eight.spam.example/p/{k}" for k in range(8)] + [f"https://seven.junk.test/q/{k}" for k in range(7)]
    marks = spark.createDataFrame([(u, True) for u in spam] + [(f"https://good.test/q/{k}", False) for k in range(20_000)], "url string, bad boolean")
    table = spark.createDataFrame(list(enumerate(spam)), "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in urls.judge(table, marks).collect()}
    assert verdicts == {k: "block" if k < 8 else "allow" for k in range(15)}


def test_mined_rules_equal_counting_every_combination(spark):
    random = np.random.default_rng(4)
    rows = [(sorted(t for t in "abcdef" if random.random() < 0.5), bool(random.random() < 0.4)) for _ in range(300)]
    every = [frozenset(c) for n in range(1, 7) for c in itertools.combinations("abcdef", n)]
    counts = {c: (sum(bad for t, bad in rows if c <= set(t)), sum(c <= set(t) for t, _ in rows)) for c in every}
    good = {c: (b, b / n) for c, (b, n) in counts.items() if b >= 8 and b / n >= 0.5}
    want = {c: v for c, v in good.items() if not any(d < c for d in good)}
    found = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert {frozenset(r.antecedent): (r.support, r.confidence) for r in found} == want and want and len(found) == len(want)


@pytest.mark.parametrize("n_good", [0, 8, 9, 40])
def test_a_long_common_path_is_one_item(spark, n_good):
    """Eight bad URLs with 40 common segments: with up to eight good ones beside them each token blocks, with more none, nor all together."""
    path = "/".join(f"segment{k}" for k in range(40))
    rows = [(f"http://h{k}.test/{path}/{'abcdefgh'[k]}", True) for k in range(8)] + [(f"http://g{k}.test/{path}/x{k}y", False) for k in range(n_good)]
    table = spark.createDataFrame([(0, f"http://other.test/{path}/z"), (1, "http://other.example/a/b")], "page_id long, url string")
    verdicts = {r.page_id: r.verdict for r in urls.judge(table, spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert verdicts[0] == ("block" if n_good <= 8 else "allow")


def test_tokens_of_the_same_urls_stand_for_each_other(spark):
    """The plain rules: every smallest combination. Rules with parts of several tokens are all their choices."""
    random = np.random.default_rng(8)
    rows = []
    for _ in range(200):
        tokens = {t for t in "abcd" if random.random() < 0.6}
        rows.append((sorted(tokens | {t.upper() for t in tokens if t in "ab"}), bool(random.random() < (0.9 if {"a", "c"} <= tokens else 0.25))))
    every = [frozenset(c) for n in range(1, 7) for c in itertools.combinations("abcdAB", n)]
    counts = {c: (sum(bad for t, bad in rows if c <= set(t)), sum(c <= set(t) for t, _ in rows)) for c in every}
    good = {c: b / n for c, (b, n) in counts.items() if b >= 8 and b / n >= 0.7}
    want = {c: v for c, v in good.items() if not any(d < c for d in good)}
    found = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_confidence=0.7).collect()
    assert {frozenset(c): r.confidence for r in found for c in itertools.product(*r.parts)} == want and any(len(c) > 1 for c in want)


def test_pseudonyms(spark, docs, nothing):
    assert pseudonyms.pseudonymise(nothing, b"k").count() == 0
    text = "Mail jo.doe@mail7.example.com, card 4111 1111 1111 1111, born 2000-02-29, +1 (212) 555-0101, 10.1.2.3."
    table = spark.createDataFrame([(1, text, 1), (2, "again jo.doe@mail7.example.com and 4111111111111111", 1), (3, "4111111111111112 300.1.1.1 2001-02-29", 1), (4, None, 1)], "doc_id long, text string, label int")
    hidden = pseudonyms.pseudonymise(table, b"key")
    rows = {r.doc_id: r for r in hidden.collect()}
    assert rows[1].pii_found == 5 and sorted(rows[1].pii_formats) == ["card", "date", "email", "ipv4", "phone"]
    for value in ("jo.doe@", "4111", "2000-02-29", "555-0101", "10.1.2.3"):
        assert value not in rows[1].text
    mail = re.search(r"\S+@\S+\.com", rows[1].text)[0]
    number = re.search(r"card ([\d ]+),", rows[1].text)[1].replace(" ", "")
    assert mail in rows[2].text and number in rows[2].text and pseudonyms.luhn(number) % 10 == 0
    assert rows[3].text == "4111111111111112 300.1.1.1 2001-02-29" and rows[4].text is None
    back = pseudonyms.pseudonymise(hidden.select("doc_id", "text", "label"), b"key", backwards=True)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in table.collect())
    assert [r.text for r in pseudonyms.pseudonymise(docs, b"k").collect()] == [r[1] for r in ROWS]


def layouts_of_a_day(day):
    found = [f"{day:%Y-%m-%d}", f"{day:%d.%m.%Y}", f"{day.day}.{day.month}.{day.year}", f"{day:%m/%d/%Y}", f"{day.month}/{day.day}/{day.year}"]
    return found + ([f"{day:%d/%m/%Y}"] if day.day > 12 else [])


def read_day(text):
    parts = [int(x) for x in re.split(r"\D", text)]
    if "-" in text:
        return datetime.date(*parts)
    if "." in text:
        return datetime.date(parts[2], parts[1], parts[0])
    return datetime.date(parts[2], *parts[:2]) if parts[0] <= 12 else datetime.date(parts[2], parts[1], parts[0])


def test_a_day_has_one_pseudonym_in_all_layouts():
    there, back = pseudonyms.Permutation(b"k"), pseudonyms.Permutation(b"k", True)
    seen = {}
    for n in range(0, 4000, 7):
        day = datetime.date(2019, 1, 1) + datetime.timedelta(n)
        made = [pseudonyms.rewrite(text, there)[0] for text in layouts_of_a_day(day)]
        assert len({read_day(text) for text in made}) == 1
        assert seen.setdefault(read_day(made[0]), day) == day
        assert {read_day(pseudonyms.rewrite(text, back)[0]) for text in made} == {day}


@pytest.mark.parametrize(
    "forms",
    [
        ["+442079460958", "+44 2079460958", "+44 20 7946 0958", "+44-20-7946-0958"],
        ["+12125550101", "+1 212 555 0101", "+1 (212) 555-0101", "(212) 555-0101", "212-555-0101", "212.555.0101"],
        ["+3531234567", "+353 123 4567"],
    ],
)
def test_a_phone_number_has_one_pseudonym_in_all_layouts(forms):
    there, back = pseudonyms.Permutation(b"k"), pseudonyms.Permutation(b"k", True)
    made = [pseudonyms.rewrite(f"call {text} now", there)[0] for text in forms]
    digits = [re.sub(r"\D", "", text) for text in made]
    code = pseudonyms.country_code(re.sub(r"\D", "", forms[0]))
    assert len({d.removeprefix(code) if "+" in text else d for d, text in zip(digits, made)}) == 1
    assert all(text.startswith(f"call +{code}") for form, text in zip(forms, made) if form[0] == "+")
    assert made[0] != f"call {forms[0]} now"
    assert [pseudonyms.rewrite(text, back)[0] for text in made] == [f"call {text} now" for text in forms]


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_permutations(n):
    there, back = pseudonyms.Permutation(b"k"), pseudonyms.Permutation(b"k", True)
    images = [there("x", k, n) for k in range(n)]
    assert sorted(images) == list(range(n)) and [back("x", k, n) for k in images] == list(range(n))
