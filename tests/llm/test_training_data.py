"""The ten operators on odd input, and against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from odd_input import none, odd  # noqa: F401
from pyspark.sql import functions as F

from countloom.llm import boosting, components, decontamination, elias_fano, exact_dedup, html_text, language_id, lm_scoring, mixing, near_dedup, quality, revisits, textarrays, token_counts

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


# word hashes


def test_word_hashes_do_not_depend_on_place_or_window():
    texts = ["the The THE", None, "", " a b\n", "x" * 2_500_000, "q " + "y" * (1 << 20), "the", "y" * (1 << 20) + " the"]
    hashes, docs = textarrays.word_hashes(pa.array(texts))
    assert docs.tolist() == [0, 0, 0, 3, 3, 4, 5, 5, 6, 7, 7]
    assert len({int(hashes[i]) for i in (0, 1, 2, 8, 10)}) == 1 and hashes[7] == hashes[9]
    assert textarrays.word_hashes(pa.array(["x" * 2_500_000]))[0][0] == hashes[5]


def test_shingles_match_tuples():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    hashes, docs = textarrays.shingle_hashes(*textarrays.word_hashes(pa.array(texts)))
    wanted = []
    for i, t in enumerate(texts):
        w = t.split()
        wanted += [(i, tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))] if w else []
    assert docs.tolist() == [i for i, _ in wanted]
    assert len(set(zip(hashes.tolist(), [s for _, s in wanted]))) == len({s for _, s in wanted}) == len(set(hashes.tolist()))


# 1 decontamination


def brute_contaminated(docs, items):
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    runs = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    sets = {i: collections.Counter(runs(split(t))) for i, t in items if split(t)}
    found = {}
    for doc, text in docs:
        s = runs(split(text))
        for i, item in sets.items():
            if not item.keys() & set(s):
                continue
            m = sum(item.values())
            for a in range(-m, len(s)):
                window = collections.Counter(s[max(0, a) : a + m])
                common = sum((window & item).values())
                j = common / (sum(window.values()) + m - common)
                if j >= 0.8:
                    found[doc, i] = max(found.get((doc, i), 0), j)
    return found


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 9, 20, 40, 60])))) for i in range(30)] + [(90, None), (91, "!!")]
    docs = []
    for d in range(150):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            part = items[rng.randrange(30)][1].upper().split()
            kind = rng.random()
            if kind < 0.3:
                part = part[: max(1, int(len(part) * rng.uniform(0.7, 1)))]
            elif kind < 0.6:
                part[rng.randrange(len(part))] = "changed"
            elif kind < 0.7:
                part = part[len(part) // 2 :] + part[: len(part) // 2]
            at = rng.randint(0, len(words))
            words = words[:at] + part + words[at:]
        docs.append((d, ", ".join(words)))
    got = as_dicts(decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    wanted = brute_contaminated(docs, items)
    have = {(r["doc_id"], r["item_id"]): r["similarity"] for r in got}
    lost = {k: v for k, v in wanted.items() if k not in have}
    # Only a fingerprint over 20 bits off can lose a pair: a few tiny items, none that is nearly whole.
    assert not have.keys() - wanted.keys() and len(lost) <= 0.02 * len(wanted) and all(v < 0.9 for v in lost.values()), lost
    assert all(have[k] == pytest.approx(wanted[k]) for k in have)


def test_decontamination_of_odd_input(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in as_dicts(decontamination.contaminated(odd, bench))}
    assert got == {(6, 1), (7, 1), (8, 1), (10, 4)}
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(odd, bench.limit(0)).count() == 0
    left = decontamination.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 9, 11]


# 2 page text


def test_tokens_of_markup():
    page = html_text.PageNodes("<p>a&amp;b <script>var x='</p>';</script> c<br>d<!-- <p>no</p> --><p>e  <b>f</b>g</div><ul><li>h<li>i</ul><style>p{}</style>&nbsp;j")
    assert page.text([True] * len(page.tag)) == "a&b c d\n\ne fg\n\nh\n\ni\n\nj"
    assert html_text.PageNodes("").text([True]) == ""
    assert html_text.PageNodes("<div><p>unclosed <title>never</title").text([True] * 9) == "unclosed"


def test_decoding_is_consistent():
    page = html_text.PageNodes("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        odds = rng.normal(0, 3, len(page.tag))
        open_log, shut_log = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        keep = page.decode(open_log, shut_log)
        assert all(not keep[i] or keep[page.parent[i]] for i in range(1, len(keep)))

        def value(choice):
            return sum(open_log[i] if choice[i] else shut_log[i] for i in range(1, len(choice)) if choice[page.parent[i]])

        n = len(page.tag)
        best = max(value(c) for k in range(1 << (n - 1)) for c in [[True, *[bool(k >> i & 1) for i in range(n - 1)]]] if all(not c[i] or c[page.parent[i]] for i in range(1, n)))
        assert value(keep) == pytest.approx(best)


def test_trees_learn_a_threshold():
    x = np.random.default_rng(0).normal(size=(2000, 4))
    y = ((x[:, 1] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    model = boosting.fit_trees(x, y, trees=30)
    assert ((model.log_odds(x) > 0) == (y > 0)).mean() > 0.97
    assert boosting.fit_trees(np.zeros((0, 3)), np.zeros(0)).log_odds(np.zeros((2, 3))).tolist() == [0.0, 0.0]


@pytest.fixture(scope="module")
def page_trees(spark):
    return html_text.train(spark.read.parquet(f"{SF}/pages.parquet"), sample=60)


def test_page_text_of_given_and_other_templates(spark, page_trees):
    rows = spark.read.parquet(f"{SF}/pages.parquet").collect()
    texts = html_text.extract(page_trees, [r["html"] for r in rows])
    wanted = ["\n\n".join(html_text._semantic_main(r["html"])) for r in rows]
    assert np.mean([a == b for a, b in zip(texts, wanted)]) > 0.98
    rng = np.random.default_rng(7)
    other = [t for r in rows for t in html_text._other_text(r["html"])]
    hit = made = want = 0
    for r in rows[:60]:
        html = html_text.training_page(rng, html_text._semantic_main(r["html"]), other)
        page = html_text.PageNodes(html, labelled=True)
        a, b = page.text(page.main).split("\n\n"), html_text.extract(page_trees, [html.replace(html_text._MAIN, "")])[0].split("\n\n")
        hit, want, made = hit + sum((collections.Counter(a) & collections.Counter(b)).values()), want + len(a), made + len(b)
    assert hit / want > 0.93 and hit / made > 0.93


def test_pages_odd_input(spark, page_trees):
    prose = [t for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").collect() for t in r["text"].split("\n")[:-1] if "&" not in t and "<" not in t and len(t) > 80]
    long_page = "<article>" + "".join(f"<p>{t}</p>" for t in prose) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><h1>Title of it</h1><p>Text with some words, here.</p></article>", "x"), (3, "u", long_page, "x"), (3, "u", long_page, "x"), (4, "u", "<<< &bogus; <p", "x")]
    got = as_dicts(html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), page_trees))
    assert len(got) == 6 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [r["text"] for r in got if r["page_id"] in (1, 2)] == ["", ""]
    assert all(r["n_chars"] >= 0.9 * sum(map(len, prose)) > 90_000 for r in got if r["page_id"] == 3)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.main_text(empty, html_text.train(empty)).count() == 0


# 3 token counts


def test_token_counts_equal_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    letters = "abcXYZ'’sStTé É ΣσςİıÅé ̀ 　\x1c\x85\n\t09٣½<|endoftext|>🙂👩‍👧ﬁß中文​,.!"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["", "<|endoftext|>", "it's I'LL"]) for _ in range(4000)]
    counter = token_counts.PieceCounter(path)
    assert [counter.count(t) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in as_dicts(token_counts.token_counts(odd, path)))
    wanted = []
    for r in odd.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        wanted.append((r["doc_id"] or 0, len((r["text"] or "").encode()), n, n > 2048))
    assert got == sorted(wanted)
    assert token_counts.token_counts(none, path).count() == 0


# 4 language model


def test_elias_fano_and_trie():
    rng = np.random.default_rng(0)
    for n, universe in ((0, 10), (1, 1), (5, 7), (1000, 1 << 48), (20_000, 1 << 40), (900, 1000)):
        values = np.unique(rng.integers(0, universe, n).astype(np.uint64))
        sequence = elias_fano.EliasFano.build(values, universe)
        if len(values):
            assert (sequence.get(np.arange(len(values))) == values).all()
        asked = np.concatenate((values, rng.integers(0, universe, 500).astype(np.uint64)))
        place = {int(v): i for i, v in enumerate(values)}
        assert sequence.find(asked).tolist() == [place.get(int(v), -1) for v in asked]
    pairs = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 3000), rng.integers(0, 1 << 32, 3000))})
    context, word = (np.array([p[k] for p in pairs], np.uint64) for k in (0, 1))
    codes = np.arange(1, len(pairs) + 1).astype(np.uint16)
    trie = elias_fano.ContextTrie.build(context, word, codes, 1 << 48, 32)
    assert (trie.lookup(context, word) == codes).all() and not trie.lookup(context, word ^ np.uint64(1)).any()
    assert not trie.lookup(context + np.uint64(1000), word).any()


@pytest.mark.parametrize("order", [2, 3])
def test_scores_equal_counts(spark, order):
    docs = documents(spark).limit(60)
    rows = docs.collect()
    got = {r["doc_id"]: r for r in as_dicts(lm_scoring.score_texts(docs, ~language_id.held_out("doc_id", 7, 2), order=order, strength=4.0, shard_grams=2000))}
    counts = [collections.Counter() for _ in range(order + 1)]
    tokens, train = {}, {}
    for r in rows:
        tokens[r["doc_id"]] = [*re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate(LOWER)), None]
        train[r["doc_id"]] = zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2
    for d, w in tokens.items():
        if train[d]:
            padded = ["<s>"] * (order - 1) + w
            for k in range(1, order + 1):
                counts[k].update(tuple(padded[i - k + 1 : i + 1]) for i in range(order - 1, len(padded)))
    total, distinct, texts = sum(counts[1].values()), len(counts[1]), sum(train.values())
    assert len(got) == len(rows)
    for d, w in tokens.items():
        base = score = 0.0
        padded = ["<s>"] * (order - 1) + w
        for i in range(order - 1, len(padded)):
            p = (counts[1][padded[i],] + 1) / (total + distinct + 1)
            base += math.log10(p)
            for k in range(2, order + 1):
                context = tuple(padded[i - k + 1 : i])
                above = texts if set(context) == {"<s>"} else counts[k - 1][context]
                p = (counts[k][*context, padded[i]] + 4.0 * p) / (above + 4.0)
            score += math.log10(p)
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(counts[1][x,] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, abs=0.011 * len(w))


def test_scores_of_odd_input(spark, odd, none):
    got = as_dicts(lm_scoring.score_texts(odd, F.col("doc_id") != 5))
    assert len(got) == odd.count() and all(r["n_tokens"] >= 1 and r["score"] <= 0 for r in got)
    assert next(r for r in got if r["doc_id"] == 1)["n_tokens"] == 1
    assert lm_scoring.score_texts(none, F.lit(True)).count() == 0
    assert len(as_dicts(lm_scoring.score_texts(odd, F.lit(None).cast("boolean")))) == odd.count()


# 5 language


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "ba", "aba"]
    rng = np.random.default_rng(1)
    probs = rng.uniform(0.01, 0.3, (len(pieces), 2))

    def brute(word, lang):
        if not word:
            return 1.0
        total = sum(probs[i, lang] * brute(word[len(p) :], lang) for i, p in enumerate(pieces) if word.startswith(p))
        return total + (0.0 if word[0] in "ab" else language_id._FLOOR * brute(word[1:], lang))

    table = language_id.PieceTable(pieces)
    words = ["a", "ab", "abab", "babab", "abxa", "x", "aabbabab"]
    logs = language_id.word_log_probs(table, words, probs)
    assert np.allclose(logs, [[math.log(brute(w, k)) for k in (0, 1)] for w in words])
    assert np.isfinite(language_id.word_log_probs(table, ["ab" * 4000 + "x" * 500], probs)).all()
    chained = language_id.word_log_probs(table, ["abx" * 20], probs)[0]
    assert np.allclose(chained, [math.log(brute("abx" * 4, k)) * 5 for k in (0, 1)])
    counts = language_id.expected_pieces(table, ["ab"], np.ones((1, 2)), probs)
    both = probs[0] * probs[1] + probs[2]
    assert np.allclose(counts[[0, 1, 2]], [probs[0] * probs[1] / both] * 2 + [probs[2] / both])


def test_language_held_out_and_odd(spark, odd, none):
    docs = documents(spark)
    model = language_id.train(docs.where(~language_id.held_out("doc_id", 3, 1)), public_tokenizers.path("piece_bpe_32k.model"))
    found = {r["doc_id"]: r for r in as_dicts(language_id.identify(docs, model))}
    tested = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 and r["lang"]]
    assert np.mean([found[r["doc_id"]]["lang_pred"] == r["lang"] for r in tested]) > 0.97
    got = as_dicts(language_id.identify(odd, model))
    assert len(got) == odd.count() and {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 4}
    assert all(0 <= r["score"] <= 1 and (r["score"] == 0) == (r["lang_pred"] == "und") for r in got)
    empty = language_id.train(none, public_tokenizers.path("piece_bpe_32k.model"))
    assert language_id.identify(none, empty).count() == 0
    assert {r["lang_pred"] for r in as_dicts(language_id.identify(odd, empty))} == {"und"}
    kept = language_id.keep_recognised(odd)
    assert kept.columns == odd.columns and not {1, 2, 3, 4} & {r["doc_id"] for r in kept.collect()} and kept.where("doc_id IN (5, 6, 7, 8)").count() == 5


def test_rare_languages_are_learned(spark):
    docs = documents(spark).where("lang IN ('en', 'de')")
    rare = docs.where("lang = 'de'").limit(3)
    many = docs.where("lang = 'en'").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang").crossJoin(spark.range(200).withColumnRenamed("id", "copy"))
    rows = many.select((F.col("doc_id") * 1000 + F.col("copy")).alias("doc_id"), "text", "lang").unionByName(rare.select("doc_id", "text", "lang"))
    rows = rows.unionByName(spark.createDataFrame([(None, "no id, one text many times", "same")] * 500, rows.schema))
    langs, sample = language_id._sample(rows.withColumnRenamed("doc_id", "id"), 40)
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    assert langs == ["de", "en", "same"] and sizes["de"] == 3 and sizes["same"] == 1 and 10 <= sizes["en"] <= 90
    model = language_id.train(rows, public_tokenizers.path("piece_bpe_32k.model"), 40)
    assert model.langs == ["de", "en", "same"]
    found = [r["lang_pred"] for r in as_dicts(language_id.identify(documents(spark).where("lang = 'de'"), model))]
    assert np.mean([x == "de" for x in found]) > 0.9


# 6 revisits


def test_canonical_urls(spark):
    cases = {
        "HTTP://WWW.Example.com:80/a/?b=2&a=1&utm_source=x#f": "example.com/a?a=1&b=2", "https://example.com": "example.com/", "example.com?ref=q": "example.com/", " https://e.org:8080/A/B// ": "e.org:8080/A/B",
        "": "/", None: None, "https://e.org/x?utm=1&&gclid": "e.org/x?utm=1",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("c", revisits.canonical_url(F.col("url"))).collect()
    assert {r["url"]: r["c"] for r in rows} == cases


def test_revisits_of_odd_input(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    at = lambda h: None if h is None else t0 + timedelta(hours=h)
    rows = [
        ("r1", "http://a.org/", 0, True, {"etag": '"1"', "content-type": "text/html", "cache-control": "x"}), ("r2", "https://www.a.org", 5, True, {"last-modified": "m"}), ("r2", "https://www.a.org", 5, True, {"last-modified": "m"}),
        ("v1", "http://A.org/#x", 3, False, {"etag": 'W/"1"', "cache-control": "y", "content-length": "0"}), ("v2", "http://a.org", 0, False, {"etag": '"1"'}), ("v3", "http://a.org", 5, False, {"etag": '"2"'}),
        ("v4", "http://a.org", 9, False, {"last-modified": "m"}), ("v5", "http://a.org", 9, False, None), ("v6", None, 9, False, {}), ("v7", "http://a.org", None, None, {"etag": "e"}), ("v8", "http://b.org", 9, False, {}),
        (None, "http://a.org", 9, False, {}), ("v9", "http://a.org", 9, False, {"last-modified": "n"}), ("v9", "http://a.org", 9, False, {"last-modified": "n"}),
    ]
    frame = spark.createDataFrame([(i, u, at(h), f, m, "z") for i, u, h, f, m in rows], "record_id string, url string, date timestamp, is_response boolean, headers map<string,string>, status string")
    got = as_dicts(revisits.resolve_revisits(frame))
    assert len(got) == len(rows)
    assert {(r["record_id"], r["response_id"], r["status"]) for r in got} == {
        ("r1", "r1", "response"), ("r2", "r2", "response"), ("v1", "r1", "resolved"), ("v2", None, "no_earlier_response"), ("v3", "r1", "validator_mismatch"), ("v4", "r2", "resolved"), ("v5", "r2", "no_validator"),
        ("v6", None, "no_earlier_response"), ("v7", None, "no_earlier_response"), ("v8", None, "no_earlier_response"), (None, None, "no_earlier_response"), ("v9", "r2", "validator_mismatch"),
    }
    assert next(r for r in got if r["record_id"] == "v1")["headers"] == {"etag": 'W/"1"', "content-type": "text/html", "cache-control": "y"}
    assert revisits.resolve_revisits(frame.limit(0)).count() == 0


# 7 near duplicates


def brute_classes(docs):
    ids = [d for d, _ in docs]
    of, shingles, weights = near_dedup.weighted_shingles(pa.array([t for _, t in docs], pa.string()))
    cut = np.searchsorted(of, np.arange(len(docs) + 1))
    sets = [(shingles[a:b], weights[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if near_dedup.weighted_jaccard(*sets[i], *sets[j]) >= 0.8:
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, d in enumerate(ids):
        groups[root(i)].append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"v{i}" for i in range(3000)]
    docs = []
    for group in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 200))
        for _ in range(rng.choice([1, 2, 3, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), ("! " if rng.random() < 0.5 else " ").join(copy)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "one two"), (len(docs) + 3, "One, TWO!")]
    got = as_dicts(near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_classes(docs)
    sizes = collections.Counter(r["class_id"] for r in got)
    assert all(r["class_size"] == sizes[r["class_id"]] and r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_near_duplicates_with_any_punctuation(spark):
    rng = random.Random(12)
    latin = rng.choices([f"mot{i}é" for i in range(500)], k=80)
    clauses = ["".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往", k=rng.randint(4, 9))) for _ in range(80)]
    kana = ["".join(rng.choices("アイウエオカキクケコがぎぐげご", k=rng.randint(4, 9))) for _ in range(60)]
    changed = [*clauses[:40], "新" + clauses[40][1:], *clauses[41:]]
    ascii_marks, marks = [" ", ", ", ' "', "-", "'"], ["\u00a0", " – ", "“", "”", "’", "…", "\u2003", "—"]
    mixed = lambda words, gaps: "".join(w + gaps[i % len(gaps)] for i, w in enumerate(words))
    texts = [
        mixed(latin, ascii_marks), mixed(latin, marks), mixed(latin[:70], ["«", "»", " "]), mixed(clauses, "，。！"), mixed(changed, "、；？"), mixed(clauses[::-1], "，"), mixed(kana, "、。「」"), mixed(kana, "　・"),
        "“one”—two", "one two", "क्षमा कीजिए।", "क्षमा, कीजिए",
    ]
    runs = [regex.findall(r"[\p{L}\p{M}\p{N}]+", t.lower()) for t in texts]
    sets = [collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) for w in runs]
    wanted = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if sum((a & sets[j]).values()) >= 0.8 * sum((a | sets[j]).values()):
                old, new = sorted((wanted[i], wanted[j]))[::-1]
                wanted = [new if x == old else x for x in wanted]
    assert wanted == [0, 0, 0, 3, 3, 5, 6, 6, 8, 8, 10, 10]
    got = as_dicts(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [c for _, c in sorted((r["doc_id"], r["class_id"]) for r in got)] == wanted


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(2)
    elements = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    wa, wb = rng.integers(1, 6, 200), rng.integers(1, 6, 200)
    a, b = np.sort(elements[:200]), np.sort(elements[100:])
    size = 4000
    s = near_dedup.prob_minhash(np.repeat([0, 1], 200), np.concatenate((a, b)), np.concatenate((wa, wb)), 2, size)
    xa, xb = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    exact = sum(1 / sum(max(xa.get(j, 0) / xa[i], xb.get(j, 0) / xb[i]) for j in xa.keys() | xb.keys()) for i in xa.keys() & xb.keys())
    assert abs((s[0] == s[1]).mean() - exact) < 4 * (exact * (1 - exact) / size) ** 0.5
    assert not near_dedup.prob_minhash(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), 1).any()


def test_near_duplicates_of_odd_input(spark, odd, none):
    got = {r["doc_id"]: r["class_id"] for r in as_dicts(near_dedup.near_duplicates(odd))}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 6, 9: 9, 10: 10, 11: 9}
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 9, 10, 10]


def test_components_of_a_chain(spark):
    rng = random.Random(0)
    names = list(range(400))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(299)] + [(names[i], names[i]) for i in range(300, 310)] + [(names[310], names[311])]
    got = {r["node"]: r["component"] for r in as_dicts(components.components(spark.createDataFrame(links, "a long, b long")))}
    assert {got[n] for n in names[:300]} == {min(names[:300])} and got[names[310]] == min(names[310], names[311])


# 8 exact duplicates


def test_exact_duplicates_of_odd_input(spark, odd, none):
    got = as_dicts(exact_dedup.exact_duplicates(odd))
    rows = odd.collect()
    sha = lambda t: hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[sha(r["text"])].append(r["doc_id"])
    key = lambda x: tuple(str(v) for v in x)
    keep = {s: max((g for g in ids if g is not None), default=None) for s, ids in groups.items()}
    wanted = [(r["doc_id"], keep[s], len(groups[s]), r["doc_id"] == keep[s], s) for r in rows for s in [sha(r["text"])]]
    assert sorted([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in got], key=key) == sorted(wanted, key=key)
    assert exact_dedup.exact_duplicates(none).count() == 0
    left = exact_dedup.drop_exact_duplicates(odd)
    assert left.columns == odd.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 2, 3, 4, 5, 8, 9, 10, 10, 11]


def test_index_takes_later_batches(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"index_{tmp_path.name}".replace("-", "_"), 4, f"file://{tmp_path}/index")
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id long, text string")
    later = spark.createDataFrame([(9, "a"), (10, "c"), (11, "C")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in exact_dedup.exact_duplicates(first, index, "one").where("kept").collect()) == [2, 3]
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in as_dicts(exact_dedup.exact_duplicates(later, index, "two"))}
    assert got == {9: (2, False), 10: (11, False), 11: (11, True)}
    again = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in as_dicts(exact_dedup.exact_duplicates(later, index, "two"))}
    assert again == got and index.rows().count() == 3


# 9 mixing


def test_pivot_keeps_the_sum_and_the_expectations():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 50, 40).astype(float)
    p = np.full(40, 0.37)
    mean = np.zeros(40)
    for _ in range(3000):
        out = mixing.pivot_block(p, size, rng.random(40))
        assert ((out > 0) & (out < 1)).sum() <= 1 and abs((out * size).sum() - (p * size).sum()) < 1e-6
        mean += out
    assert np.abs(mean / 3000 - 0.37).max() < 0.06


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in full]
        rate = (total - sum(full.values())) / max(1e-9, sum(weight[s] for s in rest))
        over = [s for s in rest if rate * weight[s] > 2 * sizes[s]]
        if not over:
            return full | {s: rate * weight[s] for s in rest}
        full |= {s: 2.0 * sizes[s] for s in over}


def check_mix(docs, got):
    sizes = collections.Counter()
    for r in docs:
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    targets, taken, most = brute_targets(sizes), collections.Counter(), collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        most[r["source"]] = max(most[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= most[s] + 1e-6 for s in sizes)


def test_mix_of_documents_and_odd_input(spark, odd, none):
    docs = documents(spark)
    first = sorted(as_dicts(mixing.mix_sources(docs, block=16)), key=lambda r: r["doc_id"])
    check_mix(docs.collect(), first)
    assert first == sorted(as_dicts(mixing.mix_sources(docs.repartition(7), block=16)), key=lambda r: r["doc_id"])
    got = as_dicts(mixing.mix_sources(odd))
    assert len(got) == odd.count()
    check_mix(odd.collect(), got)
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.take_mix(odd)
    assert set(odd.columns) <= set(mixed.columns) and mixed.where("copies < 1").count() == 0


# 10 quality


def test_quality_held_out_and_odd(spark, odd, none):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(docs.where(~language_id.held_out("doc_id", 5, 0)), labels.where(~language_id.held_out("doc_id", 5, 0)))
    found = {r["doc_id"]: r for r in as_dicts(quality.score(docs, model))}
    tested = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([found[r["doc_id"]]["predicted"] == r["quality"] for r in tested]) > 0.93
    got = as_dicts(quality.score(odd, model))
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    blank = quality.train(none, labels.limit(0))
    assert quality.score(none, blank).count() == 0 and len(as_dicts(quality.score(odd, blank))) == odd.count()
