"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievegrid.llm import decontamination, html_text, language, mixing, pages_gold, quality, sharding, simhash, suffixes, toxicity, vectors
from sievegrid.llm.common import connected_components

DOC = "doc_id long, text string, lang string, source string, score double, label int, key long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(("", "s", "ed", "ing", "ly")) + str(r.randint(0, 99)) for _ in range(n))


def documents(spark, rows):
    """rows (doc_id, text, lang, source) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, 1.0, 1, 5) for r in rows], DOC)


HARD = [
    (1, None, None, None), (2, "", "en", "s1"), (3, "   \n\t ", "en", "s1"), (4, "word", None, "s2"),
    (5, "same text here", "en", "s1"), (6, "same text here", "en", "s1"), (6, "same text here", "en", "s1"),
    (None, "same text here", "en", None), (7, "long " * 30000, "en", "s1"), (8, "日本語   \U0001f600 ñ", "ja", "s3"),
]


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union_find(real, {x for e in real for x in e})


# --- SimHash


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks()
    assert all(any(not (m >> a & 1) and not (m >> b & 1) for m in masks) for a, b in itertools.combinations(range(64), 2))


def test_fingerprint_definition():
    import xxhash

    text = "One two\vTHREE four two x one TWO three"
    words = "one two three four two x one two three".split(" ")
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("A  B") == xxhash.xxh64_intdigest(b"a b", 42)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_links_match_all_pairs(spark):
    r = random.Random(2)
    fps = {r.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:50]:
        for _ in range(4):
            for b in r.sample(range(64), r.randint(1, 3)):
                f ^= 1 << b
            fps.add(f)
    fps = sorted(map(simhash.signed, fps))
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(bits(x["a"], x["b"]) <= 2 for x in links)
    pairs = [(a, b) for a, b in itertools.combinations(fps, 2) if bits(a, b) <= 2]
    assert union_find([(x["a"], x["b"]) for x in links], fps) == union_find(pairs, fps)


def test_simhash_hard_rows(spark):
    out = simhash.simhash_near_dedup(documents(spark, HARD)).collect()
    assert len(out) == len(HARD)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[1]["fingerprint"] == "0" * 16
    assert by[None]["component_id"] == by[6]["component_id"] == 5
    assert simhash.simhash_near_dedup(documents(spark, [])).count() == 0
    kept = simhash.keep_first(documents(spark, HARD))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"]) == [1, 4, 5, 7, 8]


def test_edited_copies_are_dropped(spark):
    r = random.Random(9)
    base = [prose(1000 + i, 120).split() for i in range(12)]
    rows = []
    for i, words in enumerate(base):
        rows.append((i * 10, " ".join(words), "en", "s"))
        for k in range(1, 4):  # the last is an edit of an edit
            words = list(words)
            words[r.randrange(10, 110)] = f"edit{i}x{k}"
            rows.append((i * 10 + k, " ".join(words), "en", "s"))
    rows += [(900 + i, prose(5000 + i, 3 + i), "en", "s") for i in range(20)]
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t, *_ in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = union_find(pairs, sets)
    kept = {x["doc_id"] for x in simhash.keep_first(documents(spark, rows)).collect()}
    assert kept == {i for i in root if root[i] == i} and len(kept) == 32
    a, b = simhash.shingles(rows[0][1]), simhash.shingles(rows[1][1])
    assert simhash.keep_first(documents(spark, [])).count() == 0
    assert np.isclose(simhash.similarity(a, b), len(sets[0] & sets[1]) / len(sets[0] | sets[1]))


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Chains of edits of one text, so that keys are shared by sets on both sides of the least similarity."""
    monkeypatch.setattr(simhash, "OUTSIDE", 3)
    monkeypatch.setattr(simhash, "INSIDE", 5)
    monkeypatch.setattr(simhash, "FIRST", 1)
    r = random.Random(4)
    base, rows = prose(77, 60).split(), []
    for i in range(90):
        words = list(base) if i % 10 == 0 else list(rows[-1][1].split())
        for _ in range(1 + i % 3):
            words[r.randrange(60)] = f"edit{i}"
        rows.append((i, " ".join(words), "en", "s"))
    sets = {i: set(simhash.shingles(t).tolist()) for i, t, *_ in rows}
    keys = {i: set(simhash.near_keys(simhash.shingles(t)).tolist()) for i, t, *_ in rows}
    prints = {i: simhash.fingerprint(t) for i, t, *_ in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and keys[a] & keys[b] or (prints[a] ^ prints[b]).bit_count() <= 2
    root = union_find([(a, b) for a, b in itertools.combinations(sets, 2) if alike(a, b)], sets)
    kept = {x["doc_id"] for x in simhash.keep_first(documents(spark, rows)).collect()}
    assert kept == {i for i in root if root[i] == i} and 10 < len(kept) < 80


def test_rows_stay_not_ids(spark):
    rows = [(1, prose(1, 50), "en", "s"), (1, prose(2, 50), "en", "s"), (2, prose(1, 50), "en", "s"), (3, prose(3, 50), "en", "s"), (3, prose(3, 50), "en", "t"), (None, prose(4, 50), "en", "s")]
    rows += [(None, prose(1, 50), "en", "s"), (5, None, "en", "s"), (4, "", "en", "s"), (None, prose(4, 50), "en", "s")]
    docs = documents(spark, rows)
    out = simhash.keep_first(docs)
    assert out.dtypes == docs.dtypes
    assert sorted((str(x["doc_id"]), x["text"]) for x in out.collect()) == sorted((str(i), t) for i, t, *_ in [rows[0], rows[1], rows[3], rows[5], rows[8]])


# --- Language


def test_language_ids(spark):
    text = {"en": "the thing with this other house and there", "de": "der das und nicht ein schule straße ich", "fr": "le une être pour avec français où dans"}
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(text[lang].split()) for _ in range(r.randint(4, 60))), lang, "s") for i, lang in enumerate(list(text) * 60)]
    model = language.train(documents(spark, rows[:120]))
    got = {x["doc_id"]: x for x in language.identify(documents(spark, rows[120:] + [(-1, None, "en", "s"), (-2, "12 34!", "en", "s"), (-3, "", "en", "s")]), model).collect()}
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang, _ in rows[120:])
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (-1, -2, -3))


def test_language_does_not_depend_on_the_batch():
    grams = np.unique(np.concatenate([c[i] for _, _, p, _ in language._chunks(["the cat sat"]) for c, i in language._grams(p)]))
    slots = np.zeros((1 << language.SLOTS_LOG2, 1), np.uint64)
    for at in language._slots(grams):
        slots[at, 0] |= np.uint64(1)
    model = {"langs": ["en", "xx"], "prior": "en", "slots": slots, "false": [0.0, 0.0]}
    texts = ["the cat sat", "", "zzz", "cat", None, "sat the"]
    alone = [language.predict_texts([t], model) for t in texts]
    names, scores = language.predict_texts(texts, model)
    assert names == [a[0][0] for a in alone] and scores == [a[1][0] for a in alone]


def test_language_hard_rows(spark):
    for learned in (HARD, []):
        model = language.train(documents(spark, learned))
        assert language.identify(documents(spark, HARD), model).count() == len(HARD)
    assert language.identify(documents(spark, []), model).count() == 0


def test_language_matches_exact_sets(spark):
    """The corrected popcounts against plain sets of each language's n-grams, for 70 languages of two words of bits."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def text(k, seed, n):
        r, own = random.Random(seed), random.Random(k).sample(letters, 9)
        return " ".join("".join(r.choice(own) for _ in range(r.randint(2, 7))) for _ in range(n))

    rows = [(100 * k + j, text(k, 100 * k + j, 40), f"l{k:02}", "s") for k in range(70) for j in range(6)]
    docs = documents(spark, rows)
    model = language.train(docs)
    assert len(model["langs"]) == 70 and model["slots"].shape[1] == 2
    exact = {lang: set() for lang in model["langs"]}
    for x in language.learned_grams(docs.where("text is not null")).collect():
        exact[x["lang"]].add(x["gram"])
    fresh = [(k, text(k, 99_000 + k, 60)) for k in range(70)]
    names, scores = language.predict_texts([t for _, t in fresh], model)
    for (k, t), name, score in zip(fresh, names, scores, strict=True):
        grams = [g for _, _, points, _ in language._chunks([t]) for code, inside in language._grams(points) for g in code[inside].view(np.int64).tolist()]
        hits = {lang: sum(g in own for g in grams) for lang, own in exact.items()}
        best = max(hits, key=hits.get)
        assert name == best and (hits[f"l{k:02}"] < hits[best] or name == f"l{k:02}")
        assert abs(score - hits[best] / sum(hits.values())) < 0.1


# --- Quality


def junk(seed, n):
    r = random.Random(seed)
    word = prose(seed, 1)
    return r.choice((" ".join([word] * n), prose(seed, n).upper().replace(" ", "!! "), prose(seed, n).replace(" ", "### ")))


def labelled(spark, rows, name):
    return spark.createDataFrame(rows, f"doc_id long, {name} int")


def test_quality_votes(spark):
    rows = [(i, prose(i, 50 + i) if i % 3 else junk(i, 40 + i), "en", "s") for i in range(240)]
    labels = labelled(spark, [(i, int(i % 3 > 0)) for i in range(160)] + [(3, 0), (None, 1), (9999, 1), (5, None)], "quality")
    docs = documents(spark, rows)
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, quality.train(docs, labels)).collect()}
    assert all((got[i] >= quality.THRESHOLD) == (i % 3 > 0) for i in range(160, 240))


def test_quality_votes_match_brute_force():
    x = np.stack([quality.features(prose(i, 30) if i % 2 else junk(i, 30)) for i in range(60)])
    y = np.array([i % 2 for i in range(60)], np.float32)
    model = quality.fit(x, y)
    v = quality._embed(x, model).astype(np.float64)
    want = []
    for row in v:
        cos = v @ row
        near = np.argsort(-cos)[: quality.K]
        w = np.maximum(cos[near], 0) ** 8
        want.append((w * y[near]).sum() / w.sum())
    assert np.allclose(quality.vote(x, model), want, atol=1e-3)


def test_quality_hard_rows(spark):
    docs = documents(spark, HARD)
    for labels in ([(5, 1), (8, 0), (7, 1)], []):
        out = quality.score(docs, quality.train(docs, labelled(spark, labels, "quality"))).collect()
        assert len(out) == len(HARD) and all(0 <= r["score"] <= 1 for r in out)


# --- Toxicity


def brute_segments(scores):
    """All maximal-scoring segments by their definition: split at the best segment, again and again."""
    best, at = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    left, right = brute_segments(scores[: at[0]]), brute_segments(scores[at[1] :])
    return left + [(*at, best)] + [(a + at[1], b + at[1], s) for a, b, s in right]


def test_segments_are_maximal():
    r = random.Random(8)
    for n in range(1, 60):
        scores = [r.choice((-1.37, -0.31, -0.3, 0.503, 1.711, 2.09)) + r.random() * 1e-3 for _ in range(n)]
        got, want = toxicity.segments(np.array(scores)), brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in got], [s for *_, s in want])


def test_lambda_takes_all_losses():
    lam = toxicity._lambda(np.array([2.0, -toxicity.LOSS]), np.array([3_000_000, 90_000_000]))
    assert lam != 1 and np.isclose(3 * np.exp(2 * lam) + 90 * np.exp(-toxicity.LOSS * lam), 93, rtol=1e-6)


def test_toxicity_learns(spark):
    bad = ["vilewurd", "nastyterm", "uglyname"]
    r = random.Random(5)

    def text(i):
        words = prose(i, 40 + i % 50).split()
        if i % 4 == 0:
            words[5:5] = [r.choice(bad) for _ in range(3)]
        return " ".join(words)

    rows = [(i, text(i), "en", "s") for i in range(400)]
    docs, labels = documents(spark, rows), labelled(spark, [(i, int(i % 4 == 0)) for i in range(300)], "toxic")
    model = toxicity.train(docs, labels)
    assert set(bad) <= set(model["terms"])
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    assert all((got[i]["score"] >= toxicity.THRESHOLD) == (i % 4 == 0) for i in range(300, 400))
    assert all(any(w in rows[i][1][p["start"] : p["end"]] for w in bad) for i in range(0, 400, 4) for p in got[i]["passages"])
    assert toxicity.drop_toxic(docs, labels).count() == 300


def test_toxicity_does_not_depend_on_the_partitions(spark):
    rows = [(i, prose(i, 30) + (f" quiet{i % 40} vilewurd" if i % 4 == 0 else f" quiet{i % 37}"), "en", "s") for i in range(400)]
    docs, labels = documents(spark, rows), labelled(spark, [(i, int(i % 4 == 0)) for i in range(400)], "toxic")
    kind = "term string, " + ", ".join(f"{c} long" for c in toxicity.COUNTS)

    def counts(n):
        parts = docs.select("text", (F.col("doc_id") % 4 == 0).cast("int").alias("label")).repartition(n).mapInPandas(toxicity._counted, kind)
        return {tuple(r) for r in parts.groupBy("term").agg(*[F.sum(c) for c in toxicity.COUNTS]).collect()}

    assert counts(1) == counts(200)
    one, many = (toxicity.train(docs.repartition(n), labels) for n in (1, 200))
    assert one["terms"] == many["terms"] and "vilewurd" in one["terms"]
    assert one["lambda"] == many["lambda"] and one["log_k"] == many["log_k"] and (one["logit"] == many["logit"]).all()
    scores = [{x["doc_id"]: x["score"] for x in toxicity.score(docs.repartition(n), m).collect()} for n, m in ((1, one), (64, many))]
    assert scores[0] == scores[1]


def test_toxicity_matches_plain_version(spark):
    """Counts, lower bounds, best segments and scores by definition, without the engine."""
    rows = [(i, prose(i, 20 + i % 31) + (" vilewurd nastyterm vilewurd" if i % 5 == 0 else ""), "en", "s") for i in range(200)]
    docs, labels = documents(spark, rows), labelled(spark, [(i, int(i % 5 == 0)) for i in range(200)], "toxic")
    model = toxicity.train(docs, labels)
    tokens, there, whole = {0: {}, 1: {}}, {0: {}, 1: {}}, [0.0, 0.0]
    for i, text, *_ in rows:
        words = toxicity._WORD.findall(text.lower())
        for w in set(words):
            n = round(1024 * (1 + np.log(words.count(w)))) / 1024
            whole[i % 5 == 0] += n
            for t in toxicity.terms(w):
                tokens[i % 5 == 0][t] = tokens[i % 5 == 0].get(t, 0) + n
                there[i % 5 == 0].setdefault(t, set()).add(i)
    names = sorted(t for t, d in there[1].items() if len(d) >= toxicity.LEAST_DOCS)
    a, b = (np.array([tokens[y].get(t, 0.0) for t in names]) for y in (1, 0))
    error = np.sqrt(sum(1 / (np.array([len(there[y].get(t, ())) for t in names]) + 0.5) for y in (1, 0)))
    gain = toxicity.log_odds(a, b, whole[1], whole[0], min(toxicity.PRIOR, toxicity.PRIOR_SHARE * sum(whole))) - toxicity.ERRORS * error
    want = {t: g for t, g in zip(names, gain, strict=True) if g > np.log(160 / 40)}
    assert want.keys() == model["terms"].keys() and all(np.isclose(g, model["terms"][t]) for t, g in want.items())
    for x in toxicity.score(docs, model).collect():
        words = toxicity._WORD.findall(rows[x["doc_id"]][1])
        s = [max(want.get(t, -toxicity.LOSS) for t in toxicity.terms(w.lower())) for w in words]
        best = max(sum(s[p:q]) for p in range(len(s)) for q in range(p + 1, len(s) + 1))
        significance = max(model["lambda"] * best - model["log_k"] - np.log(len(s)), 0) if best > 0 else 0
        assert np.isclose(max((p["significance"] for p in x["passages"]), default=0), significance)
        total = sum(p["significance"] for p in x["passages"])
        z = np.array([1, np.log1p(significance), np.log1p(total)]) @ model["logit"]
        assert np.isclose(x["score"], 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def test_toxicity_hard_rows(spark):
    docs = documents(spark, HARD)
    for labels in ([(5, 1), (8, 0), (7, 0), (1, 1)], []):
        out = toxicity.score(docs, toxicity.train(docs, labelled(spark, labels, "toxic"))).collect()
        assert len(out) == len(HARD) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(documents(spark, []), toxicity.train(docs, labelled(spark, [], "toxic"))).count() == 0


# --- Decontamination


def test_contamination_matches_brute_force(spark):
    items = [(i, ". ".join(prose(100 + 7 * i + k, 8 + i) for k in range(1 + i % 3)) + ".") for i in range(20)] + [(50, "tiny item"), (51, ""), (None, None)]
    rows = []
    for i in range(120):
        words = prose(1000 + i, 30 + 3 * i).split()
        if i % 3 == 0:
            at = random.Random(i).randint(0, len(words))
            words[at:at] = items[i % 21][1].split()[: None if i % 2 else -2]
        rows.append((i, " ".join(words), "en", "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontamination.contamination(documents(spark, rows), bench).collect()}
    want = set()
    for i, t in items:
        own = decontamination.words(t)
        grams = decontamination.shingles(own)
        for d, text, *_ in rows:
            there = decontamination.shingles(decontamination.words(text), min(5, len(own)) or 1)
            if grams and len(grams & there) >= 0.8 * len(grams):
                want.add((d, i))
    assert got == want and len(want) > 20
    clean = decontamination.drop_contaminated(documents(spark, rows), bench)
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_contamination_in_parts_and_hard_rows(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "same text here"), (2, "word"), (2, "word")], "item_id long, text string")
    docs = documents(spark, HARD)
    want = sorted((str(x["doc_id"]), x["item_id"]) for x in decontamination.contamination(docs, bench).collect())
    assert want == [("4", 2), ("4", 2), ("5", 1), ("6", 1), ("6", 1), ("None", 1)]
    items = decontamination.distinct_items(bench)
    parts = list(decontamination.indexes(items, most_bytes=4))
    assert len(parts) > 1 and sum(len(p.items) for p in parts) == 2
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, empty).count() == 0
    assert decontamination.contamination(documents(spark, []), bench).count() == 0
    assert decontamination.drop_contaminated(docs, empty).count() == len(HARD)
    monkeypatch.setattr(decontamination, "MOST_SUMS", 2)
    texts = [prose(i, 12) for i in range(9)]
    index = decontamination.Index(list(enumerate(texts)), *decontamination.statistics(texts))
    text = " ".join([prose(77, 500), prose(4, 12), prose(78, 300)])
    assert [h[0] for h in index.search(text) if h[3]] == [4]


def test_scores_do_not_depend_on_the_number_of_indexes(spark, monkeypatch):
    items = [(i, prose(500 + i // 2, 10 + i // 2)) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{prose(i, 20 + i)} {items[i][1]} {prose(i + 99, 15)}", "en", "s") for i in range(40)]
    found = []
    for most in (1 << 20, 900):
        monkeypatch.setattr(decontamination.indexes, "__defaults__", (most,))
        found.append(sorted(tuple(r) for r in decontamination.contamination(documents(spark, rows), bench).collect()))
    assert len(found[0]) >= 80 and found[0] == found[1]


def test_items_are_found_at_every_offset():
    opening = "which of the following statements about this topic is"
    items = [f"{opening} {prose(3000 + i, 6 + i)} as given" if i % 2 else prose(3000 + i, 4 + 2 * i) for i in range(30)]
    index = decontamination.Index(list(enumerate(items)), *decontamination.statistics(items))
    common = opening.split()
    for k, item in enumerate(items):
        for at in range(0, 2 * max(16, 1 << len(item.split()).bit_length()) + 1):
            before = [prose(at * 31 + j, 1) if j % 3 else common[j % len(common)] for j in range(at)]
            text = " ".join([*before, item, prose(at + 7, at % 5)])
            assert k in [h[0] for h in index.search(text) if h[3]], (k, at)


# --- Sharding


def check_shards(rows, shards):
    sizes = [sum(r["shard"] == s for r in rows) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_shards_are_even_and_keep_copies_together(spark):
    rows = [(i, f"text {i if i > 150 else i // 3}", "en", "s") for i in range(403)]
    out = sharding.shard_documents(documents(spark, rows)).collect()
    check_shards(out, 16)
    text = {r[0]: r[1] for r in rows}
    where = {}
    for r in out:
        assert r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode())
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 2


def test_a_third_in_one_group_stays_even(spark):
    rows = [(i, "copy" if i % 3 == 0 else f"text {i}", "en", "s") for i in range(900)]
    out = sharding.shard_documents(documents(spark, rows)).collect()
    check_shards(out, 16)
    assert len({r["shard"] for r in out if r["doc_id"] % 3 == 0}) <= 8


def test_sharding_hard_rows(spark):
    out = sharding.shard_documents(documents(spark, HARD)).collect()
    assert len(out) == len(HARD)
    check_shards(out, 16)
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] == 1} == {(1, 0)}
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_allowed_moves_respect_capacity():
    r = np.random.default_rng(1)
    for _ in range(20):
        wanted, held = r.integers(0, 50, (6, 6)).astype(float), r.integers(100, 300, 6).astype(float)
        np.fill_diagonal(wanted, 0)
        capacity = np.maximum(held, 250.0)
        moves = sharding.allowed_moves(wanted, held, capacity)
        assert (moves <= wanted + 1e-9).all() and (held - moves.sum(1) + moves.sum(0) <= capacity + 1e-6).all()


# --- Mixing


def plain_mix(docs, weights, percent, epochs, seed):
    """The same rule in Python: docs (id, path tuple, tokens)."""
    import hashlib

    supply = {}
    for _, path, t in docs:
        for k in range(len(path) + 1):
            supply[path[:k]] = supply.get(path[:k], 0) + t * epochs
    budget = {(): sum(t for *_, t in docs) * percent // 100}
    for depth in range(len(docs[0][1]) if docs else 0):
        for parent in [p for p in supply if len(p) == depth]:
            kids = sorted((p for p in supply if len(p) == depth + 1 and p[:-1] == parent), key=lambda p: (supply[p] / weights(p), p[-1]))
            left, share = budget[parent], sum(weights(p) for p in kids)
            while kids and supply[kids[0]] * share <= weights(kids[0]) * left:
                p = kids.pop(0)
                budget[p] = supply[p]
                left -= supply[p]
                share -= weights(p)
            budget |= {p: weights(p) * left // share for p in kids}
    out = []
    for leaf in {p for _, p, _ in docs}:
        own = [(d, t) for d, p, t in docs if p == leaf]
        tokens = sum(t for _, t in own)
        if not tokens or not budget[leaf]:
            continue
        whole, rest = divmod(budget[leaf], tokens)
        out += [(d, e) for d, _ in own for e in range(whole)]
        keyed = sorted((hashlib.md5(f"{seed}:{whole}:{d}".encode()).hexdigest(), d, t) for d, t in own)
        for key, d, _ in keyed:
            if rest and sum(t for k, _, t in keyed if k <= key) <= rest:
                out.append((d, whole))
    return sorted(out)


@pytest.mark.parametrize("percent", [20, 60, 140])
def test_mix_matches_plain_version(spark, percent):
    r = random.Random(percent)
    docs = [(i, (f"d{r.choice((0, 0, 0, 1, 2))}", r.choice(("en", "de")), f"s{r.randint(0, 4)}"), r.choice((0, 1, 5, 30, 200))) for i in range(600)]
    frame = spark.createDataFrame([(d, *p, t) for d, p, t in docs], "doc_id long, domain string, lang string, source string, tokens long")
    table = {"domain": {"d0": 3, "d1": 2}, "lang": {"en": 4}, "source": {}}
    columns = {k: mixing.weight_of(k, v) for k, v in table.items()}
    got = mixing.mix(frame, ["domain", "lang", "source"], columns, percent)
    want = plain_mix(docs, lambda p: list(table.values())[len(p) - 1].get(p[-1], 1), percent, mixing.EPOCHS, mixing.SEED)
    assert sorted((x["doc_id"], x["epoch"]) for x in got.collect()) == want


def test_mixing_hard_rows(spark):
    docs = documents(spark, HARD)
    out = mixing.mix_documents(docs, 60)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.mix_documents(documents(spark, []), 60).count() == 0
    assert mixing.mix_documents(documents(spark, [(1, None, None, None)]), 60).count() == 0


# --- Vectors


def brute_links(rows):
    names = [r[0] for r in rows]
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1]) for r in rows]
    links, pairs = dict.fromkeys(names, 0), []
    for i, j in itertools.combinations(range(len(rows)), 2):
        if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= vectors.THRESHOLD:
                links[names[i]] += 1
                links[names[j]] += 1
                pairs.append((names[i], names[j]))
    return links, union_find(pairs, names)


def vector_rows(n, dim=12, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, dim))
    for i in range(n):
        if i % 4 == 1:
            base[i] = base[i - 1] + r.normal(size=dim) * 0.12
        if i % 9 == 0 and i:
            base[i] = base[0] + r.normal(size=dim) * 0.1
        if i % 25 == 3:
            base[i] = base[2]
    return [(i, [float(v) for v in np.float32(base[i])], i % 2) for i in range(n)]


@pytest.mark.parametrize("target", [1000, 40])
def test_vector_links_match_brute_force(spark, target, monkeypatch):
    monkeypatch.setattr(vectors, "TARGET", target)
    nan, inf = float("nan"), float("inf")
    rows = vector_rows(260) + [(900, None, 1), (901, [0.0] * 12, 1), (902, [nan] + [1.0] * 11, 1), (903, [inf] + [1.0] * 11, 1), (904, [1.0] * 12, None), (905, [1.0] * 5, 1), (906, [], 0), (907, [None] + [1.0] * 11, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {x["vec_id"]: x for x in vectors.link_vectors(frame.withColumn("n", F.lit(1)).withColumn("cluster", F.lit("x"))).collect()}
    links, component = brute_links(rows)
    assert len(out) == len(rows)
    off = sum(out[i]["n_links"] != links[i] or out[i]["component_id"] != component[i] for i in out)
    assert off <= (0 if target == 1000 else 0.02 * len(rows))
    assert all(0.99 <= x["audit_recall"] <= 1 for x in out.values())
    assert all(out[i]["kept"] == (out[i]["component_id"] == i) for i in out)
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in range(900, 908))


@pytest.mark.parametrize("dim", [16, 64, 256])
@pytest.mark.parametrize("most", [4096, 20])
def test_routes_meet_at_the_threshold(dim, most):
    """Random pairs at exactly the threshold share a cluster, with one set of centroids and with residuals."""
    r = np.random.default_rng(dim)
    x = r.normal(size=(4000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = 100_000
    cells = vectors.cut(x, n, 2000, most)
    size = len(cells["first"]) * (1 if cells["rest"] is None else len(cells["rest"]))
    assert n * cells["homes"] / 2000 <= size < 2 * n * cells["homes"] / 2000 + most and (cells["rest"] is None) == (most > 20)
    p, away = r.normal(size=(2, 2000, dim))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    away -= (away * p).sum(1, keepdims=True) * p
    q = 0.93 * p + np.sqrt(1 - 0.93**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    a, b = (vectors.nearest_cells(v, cells, cells["homes"]) for v in (p, q))
    assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() >= 0.98


@pytest.mark.parametrize("most", [4096, 8])
def test_no_link_is_lost_between_many_clusters(spark, monkeypatch, most):
    monkeypatch.setattr(vectors, "TARGET", 60)
    monkeypatch.setattr(vectors, "CENTROIDS", most)
    monkeypatch.setattr(vectors, "ROUTED", 1.0)
    r = np.random.default_rng(11)
    base = r.normal(size=(300, 24))
    base = np.vstack([base, *(base + r.normal(size=base.shape) * 0.27 for _ in range(2))])
    rows = [(i, [float(v) for v in np.float32(x)], 0) for i, x in enumerate(base)]
    out = {x["vec_id"]: x for x in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    links, component = brute_links(rows)
    assert sum(links.values()) > 200
    assert all(out[i]["n_links"] == links[i] and out[i]["component_id"] == component[i] for i in out)


def test_split_clusters_are_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MEMBERS", 30)
    monkeypatch.setattr(vectors, "QUERIES", 25)
    rows = vector_rows(200, seed=3)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = {x["vec_id"]: x for x in vectors.link_vectors(frame).collect()}
    links, component = brute_links(rows)
    assert all(out[i]["n_links"] == links[i] and out[i]["component_id"] == component[i] for i in out)


def test_graph_search_recall():
    r = np.random.default_rng(6)
    x = r.normal(size=(700, 24))
    x[300:360] = x[0] + r.normal(size=(60, 24)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    graph = vectors._adjacency(ids, [ids[g[g >= 0]] for g in vectors.robust_prune(x)])
    truth, got = x @ x.T >= 0.93, vectors.range_search(x, x, graph, 0.93)
    assert not (got & ~truth).any() and (got & truth).sum() >= 0.99 * truth.sum()


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.link_vectors(empty).count() == 0


# --- Suffixes


def plain_spans(docs):
    windows = {}
    for d, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - suffixes.LEAST + 1):
            windows.setdefault(tuple(w[i : i + suffixes.LEAST]), set()).add((d, t))
    out = set()
    for d, t in docs:
        w = (t or "").encode().split()
        now = None
        for i in range(len(w) - suffixes.LEAST + 1):
            if len(windows[tuple(w[i : i + suffixes.LEAST])]) > 1:
                if now and i <= now[1]:
                    now[1] = i + suffixes.LEAST
                else:
                    if now:
                        out.add((d, *now))
                    now = [i, i + suffixes.LEAST]
        if now:
            out.add((d, *now))
    return out


@pytest.mark.parametrize("per_range", [suffixes.RANGE, 60])
def test_spans_match_plain_version(spark, per_range):
    r = random.Random(9)
    passages = [prose(500 + k, n).split() for k, n in enumerate((49, 50, 51, 60, 85, 120, 400))]
    docs = []
    for i in range(90):
        words = prose(2000 + i, r.randint(0, 300)).split()
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            if r.random() < 0.3:
                p = p[r.randint(0, 20) :]
            at = r.randint(0, len(words))
            words[at:at] = p
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, prose(31, 90) + f" edit{i} " + prose(32, 130)) for i in range(12)] + [(2000, docs[3][1]), (2001, "again " * 200), (2002, "other " * 60)]
    got = {(x["doc_id"], x["start"], x["end"]) for x in suffixes.repeated_spans(documents(spark, [(*d, "en", "s") for d in docs]), per_range).collect()}
    assert got == plain_spans(docs)


def test_minimisers_are_dense_enough():
    words = suffixes.Reader()(prose(1, 700))
    at = suffixes.minimisers(words)
    reach = suffixes.LEAST - suffixes.PREFIX + 1
    assert all(((at >= s) & (at < s + reach)).any() for s in range(len(words) - suffixes.LEAST + 1))


def test_ranges_say_what_one_range_says():
    """Wherever the order is cut, the neighbours and the rows at borders settle the same suffixes."""
    rows = np.random.default_rng(1)
    for _ in range(200):
        n = int(rows.integers(1, 120))
        f = pd.DataFrame({"h": rows.integers(0, 4, n), "around": rows.integers(0, 5, n), "key": rows.integers(0, 4, n), "at": rows.permutation(n)})
        f = f.sort_values(["h", "around", "key", "at"], ignore_index=True)
        settled = f.groupby(["h", "around"])["key"].transform("nunique") > 1
        lone = (f.groupby("h")["key"].transform("nunique") > 1) & ~settled
        cuts = [0, *sorted(rows.integers(0, n + 1, rows.integers(0, 12))), n]
        said = pd.concat([x for a, z in zip(cuts, cuts[1:], strict=False) for x in suffixes._neighbours(iter([f.iloc[a:z]]))])
        border = said[said["kind"] == suffixes._BORDER]
        together = border.groupby(["h", "around"])["key"].transform("nunique") > 1
        known = border.groupby("h")["key"].transform("nunique") > 1
        inside = set(said["at"][said["kind"] == suffixes._INSIDE]) | set(border["at"][together])
        places = set(said["at"][said["kind"] == suffixes._PLACE]) | set(border["at"][known & ~together])
        assert inside == set(f["at"][settled])
        assert set(f["at"][lone]) <= places


def test_spans_hard_rows(spark):
    assert suffixes.repeated_spans(documents(spark, HARD)).count() == 0
    assert suffixes.repeated_spans(documents(spark, [])).count() == 0
    twice = [(None, "long " * 70, "en", "s"), (9, "long " * 70, "en", "s"), (9, "long " * 70, "en", "s")]
    got = [(x["doc_id"], x["start"], x["end"]) for x in suffixes.repeated_spans(documents(spark, twice)).collect()]
    assert sorted(got, key=str) == [(9, 0, 70), (None, 0, 70)]


# --- Pages


@pytest.fixture(scope="module")
def page_model():
    return html_text.train(pages_gold.labelled_pages())


PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><a href="/">Home</a> <a href="/b">Blog</a></header><nav><ul><li><a href="/x">One</a><li><a href="/y">Two</a></ul></nav>
<div class="cookie-notice">We use cookies. <button>Accept</button></div><!-- <p>hidden</p> -->
<article><h1>A   heading</h1><p>First &lt;b&gt; paragraph,&nbsp;with a <a href='q>r'>link</a> and caf&eacute; in it.
<p>Second<br>paragraph of the text which goes on for a while.<div class="ad">Buy now</div><p>Last one, the end.</article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this very much, thank you for it.</p></div></section>
<aside class="sidebar"><h3>Related</h3><ul><li><a href="/r">Other page</a></li></ul></aside>
<form><label>Search</label><input></form><footer>&copy; 2020 somebody &middot; imprint</footer></body></html>"""


def test_main_text(page_model):
    assert html_text.main_text(PAGE, page_model).split("\n") == [
        "A heading", "First <b> paragraph, with a link and café in it.", "Second paragraph of the text which goes on for a while.", "Last one, the end.",
    ]


def test_unseen_labelled_pages(page_model):
    right = wrong = 0
    for page in pages_gold.labelled_pages(80, seed=77):
        tree = html_text.Tree(page, pages_gold.MARK)
        for tag, y, p in zip(tree.tag, html_text.labels(tree), html_text.marginals(tree, page_model), strict=True):
            if tag == html_text.TEXT:
                right, wrong = right + (y == (p >= 0.5)), wrong + (y != (p >= 0.5))
    assert right / (right + wrong) > 0.97


def test_marginals_match_enumeration(page_model):
    tree = html_text.Tree("<div class='content'><p>One two three.</p><ul><li><a>x</a></li></ul>tail</div>")
    local = [sum(page_model["weights"].get(f, 0.0) for f in fs) for fs in tree.features()]
    n, total, on = len(local), 0.0, np.zeros(len(local))
    for labels in itertools.product((0, 1), repeat=n):
        e = sum(s for s, y in zip(local, labels, strict=True) if y) + sum(page_model["pair"][labels[tree.parent[i]]][labels[i]] for i in range(1, n))
        total += np.exp(e)
        on += np.exp(e) * np.array(labels)
    assert np.allclose(html_text.marginals(tree, page_model), on / total)


def test_text_around_raw_elements():
    def texts(source):
        tree = html_text.Tree(source)
        return [x for x, tag in zip(tree.text, tree.tag, strict=True) if tag == html_text.TEXT]

    assert texts("<p>\u0130\u0130\u0130<script>x</SCRIPT>abcdef</p>") == ["\u0130\u0130\u0130abcdef"]
    assert texts("<p>a<style>x</styles></style>b</p>") == ["ab"]
    for name in ("math", "object", "svg", "select", "template"):
        assert " ".join(texts(f"<p>one</p><{name}>two<p>three</p>")) == "one two three"
    assert " ".join(texts("<p>so <math><mi>x</mi></math> holds</p>")).split() == ["so", "x", "holds"]


def page_texts(source):
    tree = html_text.Tree(source)
    return [x for x, tag in zip(tree.text, tree.tag, strict=True) if tag == html_text.TEXT]


def test_plain_articles_come_out_whole(page_model):
    """Pages of little but an article, in layouts and with names that no labelled page has."""
    lost = []
    for n, low in itertools.product((1, 3, 10), (8, 15, 40, 120)):
        text = [f"{prose(n * 100 + low + k, low)}.".capitalize() for k in range(n)]
        inner = "".join(f"<p>{t}</p>" for t in text)
        for page in (
            f"<article>{inner}</article>", f"<body>{inner}</body>", inner, f"<html><head><title>x</title></head><body><main>{inner}</main></body></html>",
            f'<div class="wrap"><h1>A heading of it</h1>{inner}</div>', f'<body><div class="zzgrid"><section id="qqv">{inner}</section></div></body>',
            f"<body><x-shell><x-story>{inner}</x-story></x-shell></body>", f'<article data-gold="yes" gold="no" data-class="sidebar ad">{inner}</article>',
            f'<body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Other</a></li></ul></nav><div class="kkl">{inner}</div><footer>Imprint</footer></body>',
        ):
            got = html_text.main_text(page, page_model).split("\n")
            lost += [(page[:60], n, low) for t in text if t not in got]
    assert not lost, lost


def test_markup_that_is_no_text():
    assert page_texts('<p>a</p><script src="a.js"/>var x = "<p>code</p>";</script><p>b</p>') == ["a", "b"]
    assert page_texts("<p>x <svg><style/><path d='m'/></svg> y</p>") == ["x y"]
    for name in ("data", "ruby", "output", "nobr", "x-term", "math", "object"):
        assert page_texts(f"<p>one <{name} value='3'>two</{name}> three</p>") == ["one two three"]
    assert html_text.Tree('<div data-class="ad" my-id=\'b\' title="class=side" CLASS=story id>x</div>').names[1] == ("story",)


def test_hostile_markup_takes_linear_time():
    import time

    def seconds(source):
        start = time.perf_counter()
        html_text.Tree(source)
        return time.perf_counter() - start

    for part, end in (("<b>", "</i>"), ("<b>", "</b>"), ("<i><table><td>" + "<b>", "</i>"), ("<p><a>", "</div>"), ("<div a=", "'")):
        small, large = (min(seconds(part * n + end * n) for _ in range(3)) for n in (2000, 16000))
        assert large < 40 * small + 0.3, (part, end, small, large)


def test_all_names_of_an_element_count():
    words = [f"b{chr(97 + i)}" for i in range(25)]
    tree = html_text.Tree(f"<div class='{' '.join(words)} sidebar'><p>x</p></div>")
    assert tree.names[1] == (*words, "sidebar")


def test_pages_hard_rows(spark, page_model):
    broken = ["", None, "   ", "plain text only", "<", "<p", "<p><b>x", "</div></p>", "<a href='", "<script>", "<!-- ", "<div " * 2000, "<p>" + "word " * 50000, PAGE, PAGE]
    frame = spark.createDataFrame([(i, None, h, 1) for i, h in enumerate(broken)], "page_id long, url string, html string, text int")
    out = {r["page_id"]: r for r in html_text.extract(frame, page_model).collect()}
    assert len(out) == len(broken) and all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert out[0]["text"] == out[1]["text"] == out[2]["text"] == ""
    assert html_text.extract(frame.limit(0), page_model).count() == 0


# --- Registered queries


@pytest.mark.parametrize("name", ["op6_mixing", "op8_suffix_dedup"])
def test_oracles(spark, name):
    import duckdb

    from sievegrid.llm import queries

    db = duckdb.connect()
    db.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want, got = db.sql(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert plain(want) == plain(got)


CONTRACTS = {
    "op1_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op5_": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op10_": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
}


@pytest.mark.parametrize("prefix", list(CONTRACTS))
def test_contracts(spark, prefix):
    from sievegrid.llm import queries

    name = next(n for n in queries.QUERIES if n.startswith(prefix))
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    kinds = dict(out.dtypes)
    assert all(kinds[c] == k for c, k in CONTRACTS[prefix].items())
    rows = out.toPandas()
    source = "embeddings" if prefix == "op7_" else "pages" if prefix == "op10_" else "documents"
    assert len(rows) == spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").count()
    if "held_out" in rows:
        rule = (lambda i: zlib.crc32(str(i).encode()) % 5 == 0) if prefix == "op1_" else (lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
        assert [rule(i) for i in rows["doc_id"]] == rows["held_out"].tolist()
        assert rows["score"].between(0, 1).all()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    sf = "/root/testdata/sf0.001"
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if name != "sharding":
            assert out.dtypes == first.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] and seen[3] > 0 and seen[4] == seen[5]
    kept = spark.read.parquet(str(tmp_path / "1"))
    marks = {r["doc_id"]: r["text"] for r in kept.collect()}
    alone = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "2")).collect()}
    texts = {}
    for i, t in marks.items():
        texts.setdefault(t, []).append(i)
    assert all(sum(i in alone for i in ids) <= 1 for ids in texts.values())


def test_pipeline_on_hard_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rows = [(i if i is None else i + 10**9, *r) for i, *r in HARD]  # ids without a label
    for given in (rows, []):
        docs = documents(spark, given)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name == "sharding":
                assert out.count() == docs.count()
                check_shards(out.collect(), 16)
            else:
                assert out.columns == docs.columns
                kept = {r["doc_id"] for r in out.collect()}
                assert kept <= {r["doc_id"] for r in docs.collect()}
                if name in ("toxicity", "decontamination"):
                    assert out.count() == docs.count()
                docs = out
    odd = documents(spark, [(1, None, None, None)] * 3)
    assert corpus_pipeline.STAGES[0][1](spark, odd, sf).count() == 3
    assert corpus_pipeline.STAGES[3][1](spark, odd, sf).count() == 0
