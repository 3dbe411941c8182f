"""URL filters, the conversation trie and phrase collocations against plain versions of them."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.corpus import LOWER
from trackloom.llm import collocations, prefix_trie, urls

# Phrases


def plain_collocations(rows, least, longest, inside, top):
    """{(lang, rank, phrase, a, l, r, n, score)} of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    held = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in held.items():
        if any(100 * b >= inside * a for (other, v), b in held.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1))):
            continue
        score, cut = min(((2000000 * a) // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:cut]], f[lang, w[cut:]]))
    return {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])}


def phrase_rows(seed=5, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["é", "Ünder", "\x1c", "x\x1dy", "#a"]
    rows = []
    for i in range(n):
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += words[min(int(rng.expovariate(0.15)), len(words) - 1)] + rng.choice([" ", " ", " ", "\t", ", ", "\n", "  ", ". "])
            if rng.random() < 0.05:
                text += "New York City Hall "
        rows.append((text, rng.choice(["aa", "bb", None])))
    return rows + [(None, "aa"), ("", None), ("a a a a a a a a a", "cc"), ("A a A a", "cc"), ("word", "dd"), ("... ,;", "dd")] + [(rows[3][0], "aa")] * 40


@pytest.mark.parametrize("heavy", [1 << 20, 20])
def test_collocations(spark, heavy):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5).withColumn("n", F.lit(1)).withColumn("phrase", F.lit("z")).withColumn("shard", F.lit(1))
    for least, inside, top in ((3, 80, 2000), (8, 50, 7)):
        found = collocations.collocations(docs, least=least, inside=inside, top=top, width=1 << 12, heavy=heavy).collect()
        assert {tuple(r) for r in found} == plain_collocations(rows, least, 4, inside, top)
        assert len({tuple(r) for r in found}) == len(found)


def test_a_crowded_sketch_changes_nothing(spark):
    rows = phrase_rows(seed=8, n=150)
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = collocations.collocations(docs, least=3, width=1 << 12).collect()
    assert {tuple(r) for r in found} == plain_collocations(rows, 3, 4, 80, 2000)


def test_each_phrase_is_counted_in_one_place(spark):
    """Fragments hold each occurrence of a frequent phrase once, whatever its words' order of rarity, ties included."""
    rows = [("a b c d a b c d a", "x"), ("b a d c b a d c", "x"), ("a a b b a a b b", "x")] * 5
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    words = collocations.word_counts(docs)
    grams = collocations.frequent_phrases(docs, collocations.sketch(words, 4096), least=1, longest=4, heavy=1 << 20).collect()
    plain = Counter()
    for text, _ in rows:
        w = text.split()
        plain.update(" ".join(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1))
    assert len(grams) == len(plain) and {r["phrase"]: r["a"] for r in grams} == dict(plain)


def test_long_texts_and_no_texts(spark):
    long = "ab cd ef " * 400_000
    docs = spark.createDataFrame([(long, "x"), ("q" * 3_000_000, "x")], "text string, lang string")
    found = {r["phrase"]: (r["a"], r["n"], r["score"]) for r in collocations.collocations(docs).collect()}
    assert set(found) == {"ab cd ef ab", "cd ef ab cd", "ef ab cd ef"}
    assert found["ab cd ef ab"] == (399_999, 1_200_001, 2000000 * 399_999 // 800_000)
    assert collocations.collocations(docs.limit(0)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("a b", "x")], "text string, lang string")).collect() == []


# Conversations


def plain_lists(rows, block=100, most=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = own.get(c - c % block, [])[:h] + t[h:]
    return out


def plain_nodes(lists):
    members = {}
    for c, w in lists.items():
        for d in range(len(w) + 1):
            members.setdefault(tuple(w[:d]), []).append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(cs) if len(lists[c]) == len(p))
        leaf = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in members)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversation_rows(seed=2, n=40):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(100, 100 + n), 250, 12345678901]:
        for t in range(rng.choice([1, 2, 3, 8])):
            rows.append((c, t if rng.random() < 0.95 else None, rng.choice(["user", "bot"]), rng.choice(["hi", "yes", "no", "päh", ""])))
    rows += [(7, 0, None, None), (7, 1, "user", None), (None, 1, "user", "lost"), (8, 2, "user", "same"), (8, 2, "user", "same"), (8, 2, "bot", "same")]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def nodes_of(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.RESULT).collect()), key=str)


@pytest.mark.parametrize("part_bytes", [1 << 20, 200, 40])
def test_trie(spark, part_bytes):
    """Many partitions hold few entries each, so that nodes run across several of them."""
    rows = conversation_rows()
    frame = spark.createDataFrame(rows, TURNS).repartition(3).withColumn("depth", F.lit(1)).withColumn("key", F.lit("k")).withColumn("units", F.lit(1))
    lists = prefix_trie.branched(prefix_trie.turn_lists(frame))
    assert nodes_of(prefix_trie.trie(lists, part_bytes=part_bytes)) == plain_nodes(plain_lists(rows))


def test_trie_of_copies_long_and_turnless_conversations(spark):
    """Three hundred equal conversations, one prefix chain of a thousand turns, and conversations without turns."""
    turns = [("user", f"t{i}") for i in range(1000)]
    lists = {c: [("user", "same"), ("bot", "same")] for c in range(300)} | {1000 + k: turns[: 250 * k] for k in range(5)} | {9000: [], 5000: turns[:1] + [("bot", "")]}
    rows = [(c, i, r, t) for c, w in lists.items() for i, (r, t) in enumerate(w)]
    frame = prefix_trie.turn_lists(spark.createDataFrame(rows, TURNS))
    empty = spark.createDataFrame([(c, []) for c, w in lists.items() if not w], "conv_id long, units array<string>")
    found = nodes_of(prefix_trie.trie(frame.unionByName(empty), part_bytes=2000))
    members = Counter(tuple(w[:d]) for w in lists.values() for d in range(len(w) + 1))
    assert len(found) == len(members) and sorted(r[3] for r in found) == sorted(members.values())
    root = next(r for r in found if r[1] == 0)
    assert root[:6] == (0, 0, None, 307, 2, 3)
    assert root[6] == sum((n - 1) * len(p[-1][1]) for p, n in members.items() if p)
    same = next(r for r in found if r[0] == 0 and r[1] == 2)
    assert same[7] == hashlib.sha256(",".join(map(str, range(300))).encode()).hexdigest()


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert nodes_of(prefix_trie.trie(prefix_trie.branched(prefix_trie.turn_lists(none)))) == []
    one = spark.createDataFrame([(5, None, None, None)], TURNS)
    assert nodes_of(prefix_trie.trie(prefix_trie.branched(prefix_trie.turn_lists(one)))) == plain_nodes(plain_lists([(5, None, None, None)]))


# Pages


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match("([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return m[1].translate(LOWER), m[2]


def plain_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return (best.host + best.path, best.verdict) if best else (None, None)


def plain_levels(host, listed):
    name = re.sub(r":\d*$", "", re.sub("^.*@", "", host))
    parts = name.split(".")
    if re.fullmatch(r"[\d.]+", name):
        return name, ""
    long = ".".join(parts[-2:]) in listed
    return ".".join(parts[-3:] if long else parts[-2:]), ".".join(parts[-2:] if long else parts[-1:])


def plain_strength(rows):
    rows = [r for r in rows if r[1] > 0]
    n, nn = sum(r[1] for r in rows), sum(r[1] ** 2 for r in rows)
    if nn <= n:
        return 2.0
    x = sum((k - m * p) ** 2 / (p * (1 - p)) for k, m, p in rows)
    rho = (x - n) / (nn - n)
    return min(1000.0, max(2.0, 1 / rho - 1)) if rho > 0 else 1000.0


def plain_verdicts(hosts, listed):
    """{host: verdict} from {host: (k, n)}."""
    level = {h: plain_levels(h, listed) for h in hosts}
    add = lambda keys: {key: tuple(sum(hosts[h][i] for h in hosts if keys(h) == key) for i in (0, 1)) for key in map(keys, hosts)}
    k, n = (sum(v[i] for v in hosts.values()) for i in (0, 1))
    tops, domains = add(lambda h: level[h][1]), add(lambda h: level[h])
    prior = {t: (k + 1) / (n + 2) for t in tops}
    s = plain_strength([(*tops[t], prior[t]) for t in tops])
    top = {t: (prior[t] * s + tops[t][0]) / (tops[t][1] + s) for t in tops}
    s = plain_strength([(*domains[d], top[d[1]]) for d in domains])
    domain = {d: (top[d[1]] * s + domains[d][0]) / (domains[d][1] + s) for d in domains}
    s = plain_strength([(*hosts[h], domain[level[h]]) for h in hosts])
    out = {}
    for h, (a, b) in hosts.items():
        w = b + s
        mean = (domain[level[h]] * s + a) / w
        out[h] = "block" if mean + 2 * math.sqrt(mean * (1 - mean) / (w + 1)) < 0.5 else "allow"
    return out


def page_rows(seed=4):
    rng = random.Random(seed)
    rows = [(None, "http://a.com/x"), (1, None), (2, "no scheme"), (3, "http://"), (4, "x://y://z.net/es/"), (5, "HTTP://WWW.Example.COM/en/A?b#c"), (6, "http://example.com/EN/"), (7, "http://com"), (8, "http://com/"), (9, "http://notcom/"), (10, "http://ÄB.net/fr/ü"), (11, "http://10.0.0.1:80/"), (12, "http://user@shop.co.uk:8080/p"), (13, "http://h.org?q=://z"), (14, "http://h.org#/en/"), (15, "http://xexample.com/en/"), (16, "http://a.net/es"), (17, "http://n\n.net/fr/\nx")]
    bad = {f"h{i}": rng.random() for i in range(12)}
    for i in range(20, 500):
        h = rng.choice(list(bad))
        path = "/fr/" if rng.random() < bad[h] else "/en/"
        rows.append((i, f"https://{h}.{rng.choice(['one', 'two'])}.{rng.choice(['net', 'org', 'co.uk'])}{path}{i}"))
    return rows + [(600, "http://" + "a." * 20_000 + "net/fr/"), (600, "http://" + "a." * 20_000 + "net/fr/")]


def test_urls(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4).withColumn("host", F.lit("clash")).withColumn("rule", F.lit("x")).withColumn("k", F.lit(1)).withColumn("n", F.lit(1))
    found = urls.judge(pages, urls.RULES).collect()
    outcomes, plain = {}, []
    for page, url in rows:
        host, path = plain_split(url)
        rule, verdict = plain_rule(host, path, urls.RULES)
        k, n = outcomes.get(host, (0, 0))
        outcomes[host] = (k + (verdict == "allow"), n + (verdict is not None))
        plain.append((page, host, path, rule, verdict))
    reputed = plain_verdicts(outcomes, urls.SUFFIXES)
    plain = [(*row[:4], row[4] or reputed[row[1]]) for row in plain]
    assert sorted(map(tuple, found), key=str) == sorted(plain, key=str)
    assert {"allow", "block"} == {r["verdict"] for r in found if r["rule"] is None}


def test_reputation_from_labels(spark):
    """Outcomes of labelled pages: a bad host is blocked, one page more of it too, a host of a bad domain as well, an unknown host passes."""
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 5}.bad.com/{i}", rng.random() < 0.02) for i in range(400)] + [(1000 + i, f"http://h{i % 7}.good.com/{i}", rng.random() < 0.97) for i in range(400)]
    rows += [(2000 + i, f"http://mixed.good.com/{i}", False) for i in range(60)] + [(3000, "http://h1.bad.com/new", None), (3001, "http://fresh.bad.com/", None), (3002, "http://fresh.good.com/", None), (3003, "http://unknown.org/", None), (3004, "http://mixed.good.com/", None), (3005, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, good boolean")
    found = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [], good=F.col("good")).collect()}
    assert [found[i] for i in (3000, 3001, 3002, 3003, 3004, 3005)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert urls.judge(pages.limit(0), urls.RULES).collect() == []
    assert {r["verdict"] for r in urls.judge(pages.drop("good"), []).collect()} == {"allow"}


def test_posterior_shrinks(spark):
    """A host's mean lies between its own share and its domain's, nearer to its own the more outcomes it has."""
    rows = [("a.x.com", 9, 10, 1), ("b.x.com", 90, 100, 1), ("c.x.com", 10, 100, 1), ("d.x.com", 0, 0, 1), ("e.y.com", 50, 100, 1)]
    found = {r["host"]: r for r in urls.reputation(spark.createDataFrame(rows, "host string, k long, n long, pages long"), suffixes=[]).collect()}
    middle = found["d.x.com"]["mean"]
    assert middle < found["a.x.com"]["mean"] < found["b.x.com"]["mean"] < 0.9 and 0.1 < found["c.x.com"]["mean"] < middle
    assert found["d.x.com"]["sd"] > found["a.x.com"]["sd"] > found["b.x.com"]["sd"]
