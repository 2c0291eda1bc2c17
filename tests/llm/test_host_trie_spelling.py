"""Host rules, the conversation trie and spelling variants against brute force, and on null, empty, long, repeated and clashing rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from forkline.llm import host_rules, prefix_trie, spelling

WORD = re.compile("[^\x20\x09-\x0d]+")
CLASH = "doc_id long, text string, source string, host string, kept string, base_failed long, n_words string, rule string, docs string, word string, `list` string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "h", "k", 1, "n", "r", "d", "w", "l", "x") for i, t, s in rows], CLASH)


def brute_measure(text):
    words = WORD.findall(text or "")
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    repeats = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeats, len(covered), len(lines)


def host_texts():
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choices("abcdé日", k=rng.randint(2, 7))) for _ in range(n))
    rows = []
    for i in range(160):
        source = f"s{i % 8}"
        text = say(rng.randint(55, 90))
        if i % 8 == 0 and rng.random() < 0.8:
            text = say(20)
        if i % 8 == 1 and rng.random() < 0.4:
            text = text.replace(" ", " # ").replace("\n", " ") + " # $"
        if i % 8 == 2 and i % 3 == 0:
            text = "\n".join([text] + ["the same line again"] * 3)
        rows.append((i, text, source))
    rows += [(500, None, "s3"), (501, "", "s3"), (502, " \n\t ", None), (None, say(60), None), (503, "a b c " * 40, "s4"), (504, "x " * 30_000, "s4"), (4, rows[4][1], "s4"), (4, rows[4][1], "s4"), (505, say(70), "rare")]
    return rows


def brute_hosts(rows):
    """What judge() gives, from counts in plain Python."""
    rules = {
        "short": lambda m: m[0] < 50, "repeats": lambda m: 100 * m[4] > 50 * m[0], "symbols": lambda m: 10 * m[2] > m[0],
        "word_length": lambda m: m[1] < 3 * m[0] or m[1] > 10 * m[0], "lines": lambda m: 10 * m[3] > 3 * m[5],
    }
    measured = [(i, s, m, {name for name, rule in rules.items() if rule(m)}) for i, t, s in rows for m in [brute_measure(t)]]
    hosts = defaultdict(list)
    for _, s, _, failed in measured:
        hosts[s].append(failed)
    rates = {}
    for rule in [*rules, "any"]:
        bad = {h: sum(bool(x) if rule == "any" else rule in x for x in got) for h, got in hosts.items()}
        n, total, squares = sum(map(len, hosts.values())), sum(bad.values()), sum(len(g) ** 2 for g in hosts.values())
        mean, free = total / n, len(hosts) - 1
        room = n - squares / n - free
        alike = 0.0
        if 0 < mean < 1 and room > 0:
            spread = sum(len(g) * (bad[h] / len(g) - mean) ** 2 for h, g in hosts.items())
            alike = min(1.0, max(0.0, (spread / (mean * (1 - mean)) - free) / room))
        for h, g in hosts.items():
            rates[h, rule] = (bad[h] * alike + (1 - alike) * mean) / (len(g) * alike + 1 - alike)
    out = []
    for i, s, m, failed in measured:
        base = bool(failed & {"short", "repeats"})
        lost = rates[s, "any"] >= 0.5 or any(rates[s, r] >= 0.2 for r in failed)
        out.append((i, s, *m, base, not base and not lost))
    return out, rates


def test_host_rules(spark):
    rows = host_texts()
    got = host_rules.judge(frame(spark, rows).repartition(5)).collect()
    want, rates = brute_hosts(rows)
    key = lambda r: [(x is None, x) for x in r]
    assert sorted([(r.doc_id, r.host, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.base_failed, r.kept) for r in got], key=key) == sorted(want, key=key)
    # one host goes whole, one for a rule of its own, and the rest keeps what fails nothing
    assert rates["s0", "any"] >= 0.5 and rates["s1", "symbols"] >= 0.2 > rates["s5", "symbols"]
    assert all(not r.kept for r in got if r.host == "s0") and any(r.kept for r in got if r.host == "s1") and any(not r.kept and not r.base_failed for r in got if r.host == "s1")
    for r in host_rules.host_rates(host_rules.measures(frame(spark, rows), F.col("source")), host_rules.BASE_RULES | host_rules.HOST_RULES).collect():
        assert r.rate == pytest.approx(rates[r.host, r.rule], abs=1e-12)


def test_hosts_of_one_rate_are_shrunk_to_it(spark):
    rows = [(i, "w " * (10 if i % 4 == 0 else 1) + " ".join(f"a{i}b{k}" for k in range(30 if i % 4 == 0 else 60)), f"s{i % 100 // 4}") for i in range(1000)]
    rates = host_rules.host_rates(host_rules.measures(frame(spark, rows), F.col("source")), {"short": "n_words < 50"}).collect()
    assert {round(r.rate, 12) for r in rates} == {0.25}
    # of hosts from 10 to 30 of a hundred, one with a single bad document is not known to be bad
    rows = [(i, "short" if i // 10 % 10 < 1 + i % 3 else " ".join(f"x{k}y{i}" for k in range(60)), f"h{i % 3}") for i in range(600)] + [(1000, "short", "once")]
    rates = {r.host: r.rate for r in host_rules.host_rates(host_rules.measures(frame(spark, rows), F.col("source")), {"short": "n_words < 50"}).where("rule = 'short'").collect()}
    assert 0.1 < rates["h0"] < 0.15 < rates["h1"] < 0.25 < rates["h2"] < 0.3 and 0.2 < rates["once"] < 0.3


def test_host_filter_keeps_columns(spark):
    docs = frame(spark, host_texts())
    kept = host_rules.keep_good(docs)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in host_rules.judge(docs).where("kept").collect()}
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect() if r.doc_id in good)


def test_host_rules_of_one_host_and_of_none(spark):
    assert host_rules.judge(frame(spark, []).where("false")).collect() == []
    one = host_rules.judge(frame(spark, [(i, "a", "s") for i in range(5)]))
    assert [(r.host_failures, r.host_rejected, r.kept) for r in one.collect()] == [(5, True, False)] * 5


TURNS = "conv_id long, turn long, role string, text string, depth long, conv string, name string, parent string, x string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, 7, "c", "n", "p", "x") for r in rows], TURNS)


def brute_trie(rows):
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(got, key=lambda x: x[0])] for c, got in said.items()}
    made = {}
    for c, got in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = tuple(own.get(c - c % 20, [])[:h] + got[h:])
    nodes = defaultdict(list)
    for c, got in made.items():
        for d in range(len(got) + 1):
            nodes[got[:d]].append(c)
    children = defaultdict(list)
    for node in nodes:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves = sum(totals[k][0] for k in children[node]) or 1
        words = len(WORD.findall(node[-1][1])) if node else 0
        totals[node] = (leaves, (len(nodes[node]) - 1) * words + sum(totals[k][1] for k in children[node]))
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        ((min(m), len(node), min(nodes[node[:-1]]) if node else None, len(m), len(children[node]), *totals[node], sha([c for c in m if made[c] == node])) for node, m in nodes.items()), key=lambda r: (r[1], r[0])
    )


def trie_rows(talked):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(talked).collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("seed", range(3))
def test_prefix_trie(spark, seed):
    rng = random.Random(seed)
    texts = ["hello there", "how are\tyou ", "", "a  b c", "sole"]
    rows = []
    for c in rng.sample(range(130), 90):
        for t in range(rng.choice([1, 2, 3, 3, 4, 5, 7, 9, 13])):
            text = None if rng.random() < 0.05 else rng.choice(texts[: 1 + (t + seed) % 5])
            rows.append((c, None if t == 0 and rng.random() < 0.2 else t, rng.choice(["user", None, "bot"]) if rng.random() < 0.1 else "user", text))
    rows += [(300 + k, t, "user", f"copy {t}") for k in range(40) for t in range(6)]  # copies, and more of them than any other beginning
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None), (41, 0, "user", "x"), (1_000_003, 0, None, None)]
    rows += [(777, 5, "bot", "twice"), (777, 5, "bot", "twice")]
    rng.shuffle(rows)
    # ties of turn go by hash, so only equal rows may tie here
    seen, kept = {}, []
    for r in rows:
        if seen.setdefault(r[:2], r) == r:
            kept.append(r)
    assert trie_rows(talks(spark, kept).repartition(6)) == brute_trie(kept)


def test_prefix_trie_of_long_talks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_IN_BLOCK", 3)
    rows = [(20 * k, t, "u", "same" if t < 150 else f"own {k % 3} {t // (40 + k % 2)}") for k in range(12) for t in range(200 + k % 4)]
    rows += [(20 * k, t, "u", "w " * 2000) for k in range(20, 24) for t in range(2)]
    assert trie_rows(talks(spark, rows).repartition(5)) == brute_trie(rows)


def test_prefix_trie_without_turns(spark):
    assert trie_rows(talks(spark, [(None, 1, "u", "t")])) == []
    # 1 takes all of its turns from 0, which is not there, and may be left without any
    for c in range(1, 9):
        rows = [(c, t, "u", "t") for t in range(1)]
        assert trie_rows(talks(spark, rows)) == brute_trie(rows)


def brute_words(rows, damage):
    total = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return {w: n for w, n in total.items() if n >= 3}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if v != w and brute_near(v, w)] for w in n}
    form = {}
    for w, vs in near.items():
        top = max(vs, key=lambda v: (n[v], [-ord(c) for c in v] + [1]), default=None)
        form[w] = min((v for v in vs if n[v] == n[top])) if top is not None and n[top] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r[0])


def variant_texts(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abeé×", k=rng.randint(4, 7))) for _ in range(25)] + ["prefix" + "".join(rng.choices("xyz", k=4)) for _ in range(40)] + ["ab" * 9 + x for x in ("abc", "abd", "bbc", "ab")]
    rows = []
    for i in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(stems)
            if rng.random() < 0.4:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abE") + w[k:], w[:k] + rng.choice("abÉ") + w[k + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, rng.choice([" ", ", ", "-", "1"]).join(words), "s"))
    huge = "long" * 300
    rows += [(None, " ".join(stems), "s"), (None, None, "s"), (900, "", "s"), (901, f"{huge} {huge}x {huge[1:]} {huge[:600]}q{huge[600:]} " * 4, "s"), (902, "日本語日本語 naïve naïve naïve naïves naïves naïves", "s"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize(("seed", "damage", "index"), [(1, 7, {}), (2, 97, {"frequent": 3, "longest_list": 4}), (3, 5, {"frequent": 10, "longest_list": 2, "longest": 3}), (4, 11, {"dictionary": 5, "frequent": 1, "longest_list": 30})])
def test_spelling_variants(spark, seed, damage, index):
    rows = variant_texts(seed)
    got = sorted((tuple(r) for r in spelling.spelling_variants(frame(spark, rows).repartition(5), damage=damage, **index).collect()), key=lambda r: r[0])
    want = brute_variants(brute_words(rows, damage))
    assert got == want and sum(r[1] is not None for r in want) > 20


def test_an_edit_leaves_the_grams_that_a_word_is_bound_to_share():
    rng = random.Random(5)
    for _ in range(400):
        frequent = {"".join(rng.choices("ab", k=rng.randint(2, 6))): 9 for _ in range(rng.randint(0, 40))}
        word = "".join(rng.choices("abc", k=rng.randint(5, 14)))
        k = rng.randrange(len(word))
        for other in (word[:k] + "b" + word[k + 1 :], word[:k] + "a" + word[k:]):
            if other == word:
                continue
            (l1, r1, n1), (l2, r2, n2) = (spelling.decompose(w, frequent, len(word)) for w in (word, other))
            alike = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            shared = alike(l1, l2) + alike(r1, r2)
            assert shared >= len(l1) + len(r1) - n1 >= 1 and shared >= len(l2) + len(r2) - n2 >= 1
            assert spelling.one_edit(word, other)


def test_long_lists_are_split(spark, monkeypatch):
    words = spark.createDataFrame([(f"beginning{a}{b}{c}ending", 3) for a in "abcde" for b in "abcde" for c in "abcde"], "word string, n long")
    monkeypatch.setattr(spelling, "LIST", 8)
    got = {tuple(sorted((r.word, r.near))) for r in spelling.near_words(words, longest_list=8).collect()}
    every = [r.word for r in words.collect()]
    assert got == {(a, b) for a in every for b in every if a < b and brute_near(a, b)} and len(got) == 3 * 10 * 25


def test_spelling_of_nothing(spark):
    assert spelling.spelling_variants(frame(spark, [(1, None, "s"), (2, "abc de", "s")])).collect() == []
