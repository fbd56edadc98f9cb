"""Operators of the llm subpackage against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphcover.llm import chat, decontam, licenses, linededup, mixing, neardup, perplexity, quality, simhash, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCAB = [f"w{i}" for i in range(60)] + ["the", "of", "été", "straße"]


def text_of(rng, n):
    return "".join(rng.choice(VOCAB) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(5)
    base = [text_of(rng, rng.randrange(1, 200)) for _ in range(30)]
    return [*base, base[0], base[1], None, "", " ", "\n\n", "one", "two words", "a" * 3000, text_of(rng, 20_000), "  lead and trail  ", "\x00 \x1f \x85 \xa0 x"]


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    rows = [(i, t, ["en", "de", None][i % 3], f"s{i % 4}" if i % 5 else None, len(t or "")) for i, t in enumerate(odd_texts)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(
        {c: F.lit("clash") for c in ("fp", "rep", "size", "target", "component", "score", "n_words", "_id", "class", "segment")}
    )


@pytest.fixture(scope="module")
def no_docs(docs):
    return docs.filter("doc_id < 0")


# --- op1


def test_quality_measures(docs, odd_texts):
    got = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    for i, t in enumerate(odd_texts):
        t = t or ""
        words = WORD.findall(t)
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        n = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if n[g] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want = (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(got[i][m] for m in quality.MEASURES[:5]) == want, i


def test_quality_ablation(docs, no_docs):
    entries = quality.ledger(docs)
    rows = entries.collect()
    for r in quality.ablations(entries, quality.STRICT).collect():
        bit, mask = quality.BITS[r["rule"]], quality.STRICT.mask
        assert r["failed"] == sum(bool(x["fail_bits"] & bit) for x in rows)
        assert r["kept_without"] == sum(not x["fail_bits"] & mask & ~bit for x in rows)
    assert quality.ledger(no_docs).count() == 0


# --- op2


def brute_licenses(text, templates):
    words = licenses.text_words(text or "")[0]
    out = {}
    for t in templates:
        for a in range(len(words)):
            grams, common = set(), set()
            for w in range(a + 1, len(words)):
                pair = (words[w - 1], words[w])
                grams.add(pair)
                common |= {pair} & t.grams
                if len(grams) > t.most:
                    break
                value = 2 * len(common) / (len(grams) + len(t.grams))
                if value >= licenses.DICE:
                    out[t.license, t.number] = max(out.get((t.license, t.number), 0), value)
    return out


def test_licenses(spark, no_docs):
    rng = random.Random(2)
    texts = [None, "", "released under the mit licence", "Nothing here at all", "in one line: " + licenses.TEMPLATES["MIT"][2].replace("\n", " ") + " and on it goes"]
    sure = {4: "MIT"}
    for name, own in licenses.TEMPLATES.items():
        for t in own:
            sure[len(texts)] = name
            texts.append("some words before " + "\n".join(t.split("\n")) + " and words behind")
            words = t.split(" ")
            words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words) + "\n" + rng.choice(list(licenses.TEMPLATES.values()))[0])
    texts.append("This work is licensed under the GNU General Public License, version 2. " * 3)
    sure[len(texts) - 1] = "GPL-2.0"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("license", "dice", "template")})
    templates = licenses.compile_templates()
    for r in licenses.scan(df).collect():
        want = brute_licenses(texts[r["doc_id"]], templates)
        assert r["dice"] == (max(want.values()) if want else None)
        assert set(r["licenses"]) <= {x for x, _ in want} and bool(r["licenses"]) == bool(want)
        if want:
            assert want[r["license"], r["template"]] == r["dice"] and r["license"] in r["licenses"]
            words, lines = licenses.text_words(texts[r["doc_id"]])
            assert (lines[r["first_word"]], lines[r["last_word"]]) == (r["first_line"], r["last_line"])
            grams = licenses.bigrams(words[r["first_word"] : r["last_word"] + 1])
            t = next(t for t in templates if (t.license, t.number) == (r["license"], r["template"]))
            assert r["dice"] == 2 * len(grams & t.grams) / (len(grams) + len(t.grams))
        if r["doc_id"] in sure:
            assert r["dice"] == 1.0 and r["licenses"] == [sure[r["doc_id"]]], (r, sure[r["doc_id"]])
    assert licenses.scan(no_docs).count() == 0


def test_licenses_of_random_and_repetitive_texts():
    import time

    rng = random.Random(22)
    own = {"X": ("a b c d e f",), "Y": ("c d e f g h a b",), "Z": ("a a b a a c",)}
    templates = licenses.compile_templates(own)
    for _ in range(400):
        text = " ".join(rng.choice("abcdefghxy") if rng.random() < 0.3 else w for w in (rng.choice(list(own.values()))[0] * 2).split(" "))
        want = brute_licenses(text, templates)
        assert {m[:2]: m[2] for m in licenses.matches(licenses.text_words(text)[0], templates)} == want
    for line in ("a b c d x e f y", licenses.TEMPLATES["MIT"][0], "permission is hereby granted to the software"):
        words = licenses.text_words((line + "\n") * 20_000)[0]
        began = time.process_time()
        licenses.matches(words, licenses.compile_templates() + templates)
        assert time.process_time() - began < 10


# --- op3


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(ids)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(docs, odd_texts, no_docs):
    want = {i: brute_fingerprint(t) for i, t in enumerate(odd_texts)}
    comp = brute_components(want, lambda a, b: (want[a] ^ want[b]).bit_count() <= 2)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(odd_texts) + 1
    for r in rows:
        assert r["fp"] & (1 << 64) - 1 == want[r["doc_id"]]
        assert r["component_id"] == comp[r["doc_id"]]
    assert simhash.near_duplicates(no_docs).count() == 0


def test_ball_links(spark):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(25)} | set(seeds)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame(rows, "fp long, rep long")
    from graphcover.operators.components import components

    got = {r["node"]: r["component"] for r in components(df.selectExpr("rep node"), simhash.links(df)).collect()}
    at = dict(enumerate(sorted(fps)))
    assert got == brute_components(at, lambda a, b: (at[a] ^ at[b]).bit_count() <= 2)


# --- op4


def test_mixing(spark, docs, odd_texts, no_docs):
    rows = mixing.mix(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert len(rows) == len(odd_texts) + 1
    assert all(r["size"] == size(odd_texts[r["doc_id"]]) and 0 <= r["taken"] <= 3 * r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
    for own in by.values():
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.5 + 1e-6
    assert abs(sum(own[0]["target"] for own in by.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    assert mixing.mix(no_docs).count() == 0


def test_water_fill_and_weights(spark):
    sources = spark.createDataFrame([("a", 10, 8), ("b", 1000, 1), ("c", 500, 1), ("d", 0, 5)], "source string, source_size long, weight long")
    got = {r["source"]: r["target"] for r in mixing.water_fill(sources).collect()}
    assert got["a"] == 30 and got["d"] == 0 and got["b"] == got["c"] == (1510 - 30) / 2
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "d e", "y")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("x", 1.0)], "source string, weight double")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(docs, weights).collect()}
    assert got == {1: 5, 2: 0}


# --- op5


def brute_kneser_ney(texts):
    """log2 p of each character and end of a text, given up to ORDER - 1 characters or edges before."""
    order, edge = perplexity.ORDER, chr(perplexity.EDGE)
    grams = lambda t: [(edge * (order - 1) + t + edge)[i : i + order] for i in range(len(t) + 1)]
    tables = [Counter(g for t in texts for g in grams(t))]
    for _ in range(order - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    out = []
    for t in tables:
        n = Counter(t.values())
        n1, n2, n3, n4 = (max(n[k], 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = [0, *(min(max(x, 0.01), k - 0.01) for k, x in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))]
        by = defaultdict(list)
        for g, c in t.items():
            by[g[:-1]].append(c)
        out.append((t, d, by))

    def p(gram):
        if not gram:
            return 1 / (len(tables[-1]) + 1)
        t, d, by = out[order - len(gram)]
        own = by.get(gram[:-1])
        if not own:
            return p(gram[1:])
        c = t.get(gram, 0)
        return (c - d[min(c, 3)] + sum(d[min(x, 3)] for x in own) * p(gram[1:])) / sum(own)

    return lambda t: 2 ** (-sum(np.log2(p(g)) for g in grams(t)) / (len(t) + 1))


@pytest.mark.parametrize("chunk", [perplexity.CHUNK_BYTES, 300])
def test_perplexity_of_every_document(spark, monkeypatch, chunk):
    monkeypatch.setattr(perplexity, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(perplexity, "PIECE_BYTES", min(chunk, perplexity.PIECE_BYTES))
    rng = random.Random(3)
    alphabets = {"en": "abca bd\n", "zh": "的一是在不了有和人这", None: "aé𝄞 "}
    rows = []
    for i in range(240):
        lang = rng.choice(list(alphabets))
        rows.append((i, "".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(0, 60))), lang))
    zh = alphabets["zh"]
    rows = [(i, (zh * 8)[i % 10 : i % 10 + 10 + i % 60], lang) if lang == "zh" else (i, t, lang) for i, t, lang in rows]
    rows += [(300, zh * 8, "zh"), (301, "".join(rng.sample(zh * 8, 80)), "zh"), (302, None, "zh"), (303, "unseen ΩΨ", "el"), (304, "ab" * 3000, "en"), rows[5], (None, "abc", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("id", "gram", "chunk", "_id", "steps", "threshold", "perplexity")})
    trusted = spark.createDataFrame([(i,) for i in range(200)] + [(7,), (None,)], "doc_id long")
    out = {r["_trusted"] for r in trusted.dropna().selectExpr("doc_id _trusted").filter(perplexity.held_out(F.col("_trusted"))).collect()}
    known = [*rows[:200], rows[5]]  # a repeated row counts twice
    measure = brute_kneser_ney([t for i, t, _ in known if i not in out and t])
    want = {(i, t): measure(t) if t else None for i, t, _ in rows}
    got = perplexity.classify(df.repartition(3), trusted).collect()
    assert len(got) == len(rows)
    steps = defaultdict(list)
    for i, t, lang in known:
        if i in out and t:
            steps[lang].append(want[i, t])
            steps["every"].append(want[i, t])
    limit = {k: sorted(v)[int(np.ceil(perplexity.QUANTILE * len(v))) - 1] for k, v in steps.items()}
    text = {i: (t, lang) for i, t, lang in rows}
    for r in got:
        t, lang = text[r["doc_id"]]
        p = want[r["doc_id"], t]
        assert (p is None) == (r["perplexity"] is None)
        if p:
            assert abs(r["perplexity"] / p - 1) < 1e-4
        most = limit.get(lang, limit["every"])
        assert most <= r["threshold"] + 1e-6 <= most + 2 * perplexity.STEP
        assert r["kept"] == (p is not None and r["perplexity"] <= r["threshold"])
    by = {r["doc_id"]: r for r in got}
    assert by[300]["kept"] and not by[301]["kept"] and by[301]["perplexity"] > 2 * by[300]["perplexity"]


def test_ngrams_of_a_large_alphabet():
    texts = pa.array(["".join(chr(0x4E00 + (i * i) % 20_000) for i in range(30_000)), "", "x"], pa.large_string())
    seq, start, n = perplexity.sequence(texts)
    number, rows = perplexity.coded(seq, start, n)
    grams = perplexity.grams_of(rows).to_pylist()
    edge = chr(perplexity.EDGE)
    want = [(edge * 4 + t + edge)[i : i + 5] for t in texts.to_pylist() for i in range(len(t) + 1)]
    assert [grams[k] for k in number] == want and len(set(grams)) == len(grams)


def test_perplexity_edge_cases(spark, docs, no_docs):
    trusted = spark.createDataFrame([(i,) for i in range(0, 30, 2)], "doc_id long")
    rows = perplexity.classify(docs, trusted).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[32]["perplexity"] is None and not by[32]["kept"] and not by[33]["kept"]
    assert by[0]["perplexity"] < by[38]["perplexity"]
    assert perplexity.classify(no_docs, trusted).count() == 0
    assert all(r["kept"] == bool(r["perplexity"]) for r in perplexity.classify(docs, trusted.filter("doc_id < 0")).collect())


# --- op6


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def mutate(rng, line, n):
    s = list(line)
    for _ in range(n):
        k = rng.randrange(len(s)) if s else 0
        match rng.randrange(3) if s else 1:
            case 0:
                s[k] = rng.choice("abcdé ")
            case 1:
                s.insert(k, rng.choice("abcdé"))
            case 2:
                del s[k]
    return "".join(s)


def test_edit_automaton():
    rng = random.Random(9)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14)))
        b = mutate(rng, a, rng.randrange(0, 4)) if a and rng.random() < 0.7 else "".join(rng.choice("ab") for _ in range(rng.randrange(0, 14)))
        for tau in (1, 2, 3):
            assert linededup.within(a, b, tau) == (edit_distance(a, b) <= tau), (a, b, tau)


def test_line_keys(monkeypatch):
    rng = random.Random(14)
    lines = ["".join(rng.choice("abé𝄞") for _ in range(n)) for n in [*range(30, 70), 200]] + ["a" * 40]
    for long in (linededup.LONG, 50):
        monkeypatch.setattr(linededup, "LONG", long)
        for tau in (1, 2, 3):
            want = set()
            for k, x in enumerate(lines):
                for delta in range(tau + 1):
                    if len(x) - delta >= linededup.MIN_CHARS:
                        for i, (start, size) in enumerate(linededup.segments(len(x) - delta, tau)):
                            for at in linededup.offsets(i, start, size, len(x), delta, tau):
                                want.add((k, linededup._key(len(x) - delta, i, x[at : at + size]), delta == 0 and at == start))
            got = {(int(a), int(b), bool(c)) for a, b, c in zip(*linededup.keys_of(lines, tau))}
            assert got == want
    assert len(linededup._hash(linededup._points("x" * 120))) == 1 and linededup._key(9, 1, "ab") != linededup._key(9, 1, "ba")


def test_line_dedup(spark, no_docs, monkeypatch):
    rng = random.Random(4)
    seeds = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(30, 60))).strip() for _ in range(12)]
    rows, texts = [], {}
    for d in range(60):
        lines = [mutate(rng, rng.choice(seeds), rng.choice([0, 0, 1, 1, 2, 3])) for _ in range(rng.randrange(1, 5))] + ["short"]
        texts[d] = "\n".join(lines)
        rows.append((d, texts[d]))
    rows += [(60, None), (61, ""), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    place = {(d, k): x.strip(linededup.BLANK) for d, t in texts.items() for k, x in enumerate(t.split("\n")) if len(x.strip(linededup.BLANK)) >= linededup.MIN_CHARS}
    distinct = sorted(set(place.values()))
    close = {(a, b) for a in distinct for b in distinct if a < b and edit_distance(a, b) <= linededup.TAU}
    cls = brute_components(distinct, lambda a, b: (a, b) in close)
    first = {}
    for at, x in sorted(place.items()):
        first.setdefault(cls[x], at)
    partners = Counter(x for pair in close for x in pair)
    for group in (linededup.GROUP, 3):
        monkeypatch.setattr(linededup, "GROUP", group)
        got = {r["doc_id"]: r for r in linededup.repeated_lines(df).collect()}
        for d in texts:
            own = {k: x for (e, k), x in place.items() if e == d}
            if own:
                gone = [k for k, x in own.items() if first[cls[x]] != (d, k)]
                assert got[d]["removed_lines"] == gone
                assert got[d]["first_docs"] == [first[cls[own[k]]][0] for k in gone]
                assert got[d]["n_links"] == sum(partners[x] for x in own.values())
    left = {r["doc_id"]: r["text"] for r in linededup.drop_lines(df, linededup.repeated_lines(df)).collect()}
    for d, t in texts.items():
        assert left[d] == "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in place or first[cls[place[d, k]]] == (d, k))
    assert left[60] is None and left[61] == ""
    assert linededup.repeated_lines(no_docs).count() == 0


# --- op7


def test_toxicity_learns_and_holds_out(spark, no_docs):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(VOCAB) for _ in range(rng.randrange(20, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grumfink", "grumfinken", "Moron,", "1d10t"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "x " * 30_000), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i] >= toxicity.REJECT) == (i % 5 == 0) for i in held)
    assert right / len(held) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901] and got[902] < 0.5
    kept = {r["doc_id"] for r in toxicity.drop_toxic(df, model).collect()}
    assert kept == {i for i, s in got.items() if s < toxicity.REJECT}
    # labels of held-out rows change nothing
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit(df, flipped)).collect()} == got
    assert toxicity.score(no_docs, model).count() == 0
    assert {r["score"] for r in toxicity.score(df, toxicity.fit(df, lab.filter("toxic = 9"))).collect()} == {0.0}


def test_toxicity_ignores_the_order_of_rows(spark):
    rng = random.Random(17)
    texts = [" ".join(rng.choice([*VOCAB, "grumfink", "moron"]) for _ in range(12)) for _ in range(150)]
    rows = [(i, rng.choice(texts)) for i in range(400)]  # texts under several ids, with labels that differ
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("toxic", "fold", "_id", "_toxic", "score", "term")})
    labels = spark.createDataFrame([(i, rng.randrange(2) if rng.random() < 0.3 else int("grumfink" in t)) for i, t in rows], "doc_id long, toxic int")
    found = []
    for n in (1, 2, 3, 5, 7):
        model = toxicity.fit(df.repartition(n, F.rand(n)), labels.repartition(n, F.rand(n)))
        found.append({r["doc_id"]: r["score"] for r in toxicity.score(df, model).collect()})
    assert all(x == found[0] for x in found) and len(set(found[0].values())) > 5


def literal_features(text, learned):
    """The features of one text, word by word."""
    words = WORD.findall(text)
    told = [toxicity.plain(w) for w in words]
    weight = [max((learned.get(t, 0.0) for t in toxicity.terms_of(p)), default=0.0) for p, _ in told]
    known = [p in toxicity.LEXICON for p, _ in told]
    hit = [a or b > 0 for a, b in zip(known, weight)]
    second = [p in toxicity.SECOND for p, _ in told]
    n = max(len(words), 1)
    near = sum(h and any(second[max(0, i - toxicity.NEAR) : i + toxicity.NEAR + 1]) for i, h in enumerate(hit))
    signs = lambda chars: sum(w.count(c) for w in words for c in chars)
    return [
        100 * sum(known) / n, np.log1p(sum(known)), 100 * sum(hit) / n, np.log1p(sum(hit)), 100 * sum(weight) / n, max(weight, default=0.0), np.log1p(near),
        100 * sum(second) / n, sum(len(w) > 1 and w.isupper() for w in words) / n, signs("!") / n, signs("#*$%&|<>") / n, signs(",.?") / n,
        sum(o for _, o in told) / n, sum(o and h for (_, o), h in zip(told, hit)),
    ]


def test_toxicity_features_match_a_literal_model():
    rng = random.Random(19)
    pool = ["you", "YOU", "moron", "M0r0n!", "i.d.i.o.t", "stupid,", "fine", "grumfinken", "WOW!!", "a*b", "dich", "#tag", "?", "x"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(40)] + ["", " ", "you " * 3000 + "idiot"]
    learned = {"grumf*": 3.0, "fine": 2.7}
    got = toxicity.features(pa.array(texts, pa.large_string()), learned)
    assert np.allclose(got, [literal_features(t, learned) for t in texts])


def test_trees_match_a_literal_search():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 6, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
    trees, start = toxicity.fit_trees(x, y, n_trees=4, depth=2)
    p0 = y.mean()
    assert abs(start - np.log(p0 / (1 - p0))) < 1e-12
    margin = np.full(60, start)
    for tree, value in trees:
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        gain = lambda own: g[own].sum() ** 2 / (h[own].sum() + 1.0)
        node = np.zeros(60, int)
        for at in range(3):
            own = node == at
            options = [
                (gain(own & (x[:, f] <= c)) + gain(own & (x[:, f] > c)) - gain(own), f, c)
                for f in range(3) for c in np.unique(x[:, f])[:-1] if (own & (x[:, f] <= c)).sum() >= 3 and (own & (x[:, f] > c)).sum() >= 3
            ]
            best = max((o[0] for o in options), default=0)
            assert (at in tree) == (best > 1e-6)
            if at in tree:
                f, c = tree[at]
                own_gain = gain(own & (x[:, f] <= c)) + gain(own & (x[:, f] > c)) - gain(own)
                assert abs(own_gain - best) < 1e-9
                node[own] = 2 * at + 1 + (x[own, f] > c)
        for k in set(node):
            assert abs(value[k] - 0.15 * g[node == k].sum() / (h[node == k].sum() + 1.0)) < 1e-9
        margin = margin + value[node]
    assert np.allclose(toxicity.boosted(x, trees, start), margin)


def test_isotonic_blocks_are_the_least_squares_fit():
    rng = np.random.default_rng(2)
    x, y = np.sort(rng.normal(size=40)), rng.integers(0, 2, 40).astype(float)
    fitted = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]  # max-min formula
    at, value = toxicity.fit_isotonic(x, y)
    assert np.allclose(sorted(set(np.round(fitted, 9))), np.round(value, 9))


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-x))).astype(float)
    at, value = toxicity.fit_isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all()
    assert abs(np.interp(x, at, value).mean() - y.mean()) < 0.05


# --- op8


def test_warc_round_trip(spark, no_docs):
    rng = random.Random(8)
    body = "".join(rng.choice("abc<>\r\né") for _ in range(400))
    pages = [(i, f"http://x/{i}\nInjected: y", "".join(rng.choice("ab\r\n") for _ in range(rng.randrange(300)))) for i in range(20)]
    pages += [(30, None, body), (31, "u", body), (29, "u", body), (32, "u", None), (33, "u", ""), (34, "u", "tiny"), (35, "u", "tiny"), (36, "u", "WARC/1.1\r\n\r\n" * 50), (None, "u", body), (29, "u", body)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    archives = warc.archive_pages(df)
    got = defaultdict(list)
    for r in warc.read_records(archives).collect():
        got[r["page_id"]].append(r)
    assert sum(map(len, got.values())) == len(pages)
    for page, _, html in pages:
        raw = (html or "").encode()
        for r in got[page]:
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
            revisit = html == body and page != 29
            assert (r["record_type"], r["refers_to"]) == (("revisit", 29) if revisit else ("response", None))
            assert revisit or bytes(r["payload"]) == raw
    # members stand alone, and cover their file
    for a in archives.collect():
        data = open(a["path"].removeprefix("file://"), "rb").read()
        at = 0
        for line in open(a["index"].removeprefix("file://")):
            offset, length = map(int, line.split()[:2])
            assert offset == at and zlib.decompress(data[at : at + length], 31).startswith(b"WARC/1.1\r\n")
            at += length
        assert at == len(data)
    assert warc.read_records(warc.archive_pages(df.filter("page_id < 0"))).count() == 0


def test_warc_damage_is_an_error():
    import io

    raw = warc.record(1, "u", b"payload", "0" * 64, None)
    whole = zlib.compressobj(1, zlib.DEFLATED, 31)
    packed = whole.compress(raw + raw) + whole.flush()
    assert len(list(warc.records(io.BytesIO(packed)))) == 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(zlib.compress(raw[:-9], wbits=31))))


# --- op9


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    own, hit, ids = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for i in range(max(len(w) - 10, 0) + 1 if w else 0):
            g = w[i : i + 10]
            for k in range(len(own) - len(g) + 1):
                if own[k : k + len(g)] == g:
                    hit.update(range(k, k + len(g)))
                    ids.add(str(item))
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination(spark, odd_texts, no_docs, monkeypatch):
    rng = random.Random(6)
    source = re.sub(r"\s+", " ", odd_texts[4] * 3)
    items = [(i, text_of(rng, rng.randrange(0, 30))) for i in range(8)]
    items += [(100, source[:200]), (101, "straße The"), (102, None), (103, "!!"), (9, "w1, W2!"), (9, "w3 w4"), (104, " ".join(["w1"] * 12))]
    texts = odd_texts + [odd_texts[39] + " " + items[3][1]] + [source, "x " + items[0][1] + " y", "w1 " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_contamination(t, items) for i, t in enumerate(texts)}
    df = df.unionByName(df.filter("doc_id = 4")).withColumns({c: F.lit("clash") for c in ("row", "segment", "n_words", "items", "_row", "_at", "key")})
    for block in (decontam.BLOCK_WINDOWS, 15):
        monkeypatch.setattr(decontam.window_blocks, "__defaults__", (10, "item_id", "text", block))
        rows = decontam.contamination(df, bench).collect()
        assert len(rows) == len(texts) + 1
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in rows} == want
    assert decontam.contamination(no_docs, bench).count() == 0
    assert all(r["n_hit"] == 0 for r in decontam.contamination(df, bench.filter("item_id < 0")).collect())
    some = df.filter("doc_id IN (4, 5, 6)").withColumn("doc_id", F.lit(None).cast("long"))  # null ids are decided each by its text
    left = decontam.drop_contaminated(some, bench)
    assert left.columns == some.columns and Counter(r["text"] for r in left.collect()) == Counter(texts[i] for i in (4, 4, 5, 6) if not want[i][1])


def test_near(spark):
    texts = ["a x x b x c", "a b", "c x x x x x b a", "", None, "b c a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    found = {(r["doc_id"], r["query"]) for r in decontam.search_near(decontam.build_index(df), [("a", "b", "c"), ("a", "b")], 4).collect()}
    want = {(i, q) for i, t in enumerate(texts) for q, terms in enumerate([("a", "b", "c"), ("a", "b")]) for k in range(20) if set(terms) <= set((t or "").split()[k : k + 4])}
    assert found == want


# --- op10


CONTROL = ["<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "\\", "<", "[", "<\\s>", "[\\\\INST]", "x", "é", "\n", "$1", "|>"]


def test_chat_round_trip(spark):
    rng = random.Random(11)
    rows, convs = [], {}
    for c in range(40):
        n = rng.choice([1, 2, 3, 9, 40])
        turns = [(rng.choice(["user", "assistant", "system", None, "<|text|>"]), None if rng.random() < 0.1 else "".join(rng.choice(CONTROL) for _ in range(rng.randrange(12)))) for _ in range(n)]
        convs[c] = turns
        rows += [(c, t * 2, r, x) for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    out = chat.format_trees(chat.threads(df))
    read = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("l"))
    for r in read.collect():
        turns = [(a or "", b or "") for a, b in convs[r["conv_id"]]]
        assert [tuple(x) for x in r["t"]] == turns
        assert r["l"] == "".join(b for a, b in turns if a == "assistant")
        assert r["formatted"].count("<|turn|>") == r["formatted"].count("<|end|>") == len(turns)
        assert not re.search(r"</?s>|\[/?INST\]|<<|<\|im", r["formatted"]) or "<<" in r["formatted"]
    assert read.count() == len(convs)
    assert chat.format_trees(chat.threads(df.filter("conv_id < 0"))).count() == 0


def test_reply_trees(spark):
    rng = random.Random(12)
    rows, trees = [], {}
    for t in range(12):
        n = rng.randrange(1, 40)
        nodes = {i: (rng.randrange(i) if i and rng.random() < 0.95 else None, float(rng.randrange(5))) for i in range(n)}
        trees[t] = nodes
        rows += [(t, i, p, s, "user", f"{t}-{i}") for i, (p, s) in nodes.items()]
    rows += [(99, 1, 2, 1.0, "user", "a"), (99, 2, 1, 1.0, "user", "b"), (99, 3, 2, 1.0, "user", "c"), (98, 5, 77, None, "user", "orphan"), (None, 1, None, 1.0, "user", "null tree")]
    df = spark.createDataFrame(rows, "conv_id long, node_id long, parent_id long, score double, role string, text string")
    got = defaultdict(list)
    for r in chat.format_trees(df, score="score", top=2).withColumn("t", chat.read_turns(F.col("formatted"))).collect():
        got[r["conv_id"]].append((r["branch_rank"], [x["text"] for x in r["t"]]))
    for t, nodes in trees.items():
        paths = []
        for leaf in set(nodes) - {p for p, _ in nodes.values()}:
            path = [leaf]
            while nodes[path[-1]][0] is not None:
                path.append(nodes[path[-1]][0])
            paths.append((-sum(nodes[x][1] for x in path), leaf, [f"{t}-{x}" for x in reversed(path)]))
        assert sorted(got[t]) == [(k + 1, p[2]) for k, p in enumerate(sorted(paths)[:2])]
    assert 99 not in got and got[98] == [(1, ["orphan"])] and got[None] == [(1, ["null tree"])]


def test_bitset_passes_all_members(spark):
    from graphcover.llm import bitset

    rng = random.Random(13)
    ids = [rng.getrandbits(64) - (1 << 63) for _ in range(500)] + [0, -1, 63, 64, (1 << 63) - 1, -(1 << 63)]
    bits = bitset.bitset(spark.createDataFrame([(i,) for i in ids], "id long"))
    assert bitset.passes(bits, np.array(ids, np.int64)).all() and len(bits) * 64 == bitset.BITS
    others = np.array([rng.getrandbits(64) - (1 << 63) for _ in range(5000)], np.int64)
    assert bitset.passes(bits, others).mean() < 0.01
    assert not bitset.passes(bitset.bitset(spark.createDataFrame([], "id long")), others).any()


# --- short lines of op6, near copies of the pipeline


def test_line_dedup_short_lines(spark, tmp_path):
    rows = [(1, "short\n\nx\na line of more than thirty-two characters"), (2, "  short\nother\nx"), (3, "shirt\nshort\n \n\na line of more than thirty-two character")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_lines"], r["removed_lines"], r["first_docs"]) for r in linededup.op6_linededup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, [], []), 2: (3, [0, 2], [1, 1]), 3: (3, [1, 4], [1, 1])}


def jaccard(a, b, k=5):
    a, b = ({tuple(x[i : i + k]) for i in range(max(len(x) - k + 1, 1))} for x in (a, b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("rounds", [neardup.ROUNDS, 2, 0])
def test_near_copies(spark, monkeypatch, rounds):
    monkeypatch.setattr(neardup, "ROUNDS", rounds)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    monkeypatch.setattr(neardup, "COLUMNS", 64)
    rng = random.Random(8)
    docs = {}
    for d in range(12):
        base = [rng.choice(VOCAB) + str(rng.randrange(50)) for _ in range(150)]
        for k in range(8):
            docs[d * 10 + k] = list(base)
            for _ in range(rng.randrange(0, 7)):
                docs[d * 10 + k][rng.randrange(150)] = f"z{rng.randrange(9)}"
    comp = brute_components(list(docs), lambda a, b: jaccard(docs[a], docs[b]) >= neardup.LEAST)
    fps = {d: brute_fingerprint(" ".join(x)) for d, x in docs.items()}
    assert any(comp[d] != d and all((fps[d] ^ fps[e]).bit_count() > 2 for e in docs if e != d) for d in docs)
    rows = [(d, " ".join(x)) for d, x in docs.items()] + [(None, " ".join(docs[0])), (None, "alone without an id"), (5, "alone with a taken id"), (5, "alone with a taken id")]
    left = neardup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, " ".join(docs[d])) for d in docs if comp[d] == d] + [(None, "alone without an id"), (5, "alone with a taken id")]
    assert Counter(map(tuple, left)) == Counter(want)
