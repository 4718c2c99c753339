"""Personal data, collocations and conversation repair: against brute force on small inputs, and on odd tables."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from odd_input import none, odd  # noqa: F401
from pyspark.sql import functions as F

from countloom.llm import collocations, conversation_repair, pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 personal data


def brute_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and not all(int(x) <= 255 for x in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    for _ in range(8000):
        alphabet = rng.choice(["a@.1", "0123456789 -.+()", "1.25", "+1 (2)-.3", "a@b.c-%_+é\n1", "04 -"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 5000 + ".2.3.4", "+" * 200_000, "@" * 200_000, "a@" * 100_000, "+1" + " " * 300_000, "(at) " * 40_000])
def test_long_texts_take_linear_time(text):
    import time

    start = time.process_time()
    pii.find_spans(text, pii.Field())
    assert time.process_time() - start < 4


def all_choices(found):
    for m in range(1 << len(found)):
        chosen = sorted([c for i, c in enumerate(found) if m >> i & 1], key=lambda c: (c[0], c[2]))
        if all(x[2] <= y[0] for x, y in zip(chosen, chosen[1:])):
            yield chosen


def test_field_sums_and_choices_against_enumeration():
    g = np.random.default_rng(1)
    for _ in range(100):
        found = {}
        for _ in range(g.integers(0, 8)):
            a, k = int(g.integers(0, 8)), int(g.integers(4))
            b = a + int(g.integers(1, 4))
            found[a, k, b] = (a, k, b, np.array([int(g.integers(20))]))
        found = sorted(found.values(), key=lambda c: (c[2], c[0], c[1]))
        weights = np.zeros(pii.DIMENSIONS)
        weights[:20] = g.normal(0, 2, 20)
        field = pii.Field(weights, g.normal(0, 1, (4, 4)))
        choices = list(all_choices(found))
        values = [sum(weights[x[3]].sum() for x in c) + sum(field.touch[x[1], y[1]] for x, y in zip(c, c[1:]) if x[2] == y[0]) for c in choices]
        best = next(v for c, v in zip(choices, values) if sorted(x[:3] for x in c) == sorted(field.best(found)))
        assert best == pytest.approx(max(values))
        total, at = np.logaddexp.reduce(values), int(g.integers(len(choices)))
        value, chance, touches = pii.likelihood(field, found, {x[:3] for x in choices[at]})
        assert value == pytest.approx(values[at] - total)
        for x, p in zip(found, chance):
            assert p == pytest.approx(sum(np.exp(v - total) for c, v in zip(choices, values) if any(y is x for y in c)))
        wanted = sum((np.exp(v - total) * sum(x[2] == y[0] for x, y in zip(c, c[1:])) for c, v in zip(choices, values)), 0.0)
        assert touches.sum() == pytest.approx(wanted)


def contacts(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for _ in range(n):
        card = "4" + number(14)
        card += next(d for d in "0123456789" if pii.luhn(card + d))
        yield rng.choice([f"{word()}.{word()}@{word()}.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{number(4)}"])


def test_field_finds_other_forms_and_leaves_plain_numbers(spark):
    rng = random.Random(2)
    texts = [f"Please write {x} and some words follow here, page {rng.randint(1, 99)} of {rng.randint(100, 999)}." for x in contacts(rng, 400)]
    field = pii.train(spark.createDataFrame([(t,) for t in texts], "text string"), quota=150)
    found = wanted = false = 0
    draws = np.random.default_rng(9)
    for x in contacts(random.Random(77), 300):  # none of them was learned from
        (_, kind, _), = pii.base_spans(x)
        for text, of_kind in pii.disguises(kind, x, draws):
            whole = f"Please write {text} and more"
            base, spans = pii.find_spans(whole, field)
            if of_kind:
                wanted += 1
                found += any(s == (13, kind, 13 + len(text)) for s in spans)
            else:
                false += len(spans) > len(base)
    assert found / wanted > 0.85 and false / 300 < 0.12, (found, wanted, false)
    for plain in ("in 2024-01-15 we had 1234567 items", "order 3105554510 shipped", "pages 100-200, 1990-2010", "3.14159265", "no digits at all"):
        assert pii.find_spans(plain, field) == ([], [])


def test_private_data_of_odd_rows(spark, odd, none):  # noqa: F811
    docs = odd.unionByName(spark.createDataFrame([(20, "mail a.b@c.de, 10.0.0.7 or +1 (212) 555-0100 x"), (20, "4111 1111 1111 1111")], "doc_id long, text string"), allowMissingColumns=True)
    field = pii.train(docs)
    rows = pii.find_private(docs, field).collect()
    assert len(rows) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.where("doc_id < 20").collect()}
    for r in rows:
        if r["doc_id"] in text:
            base = brute_base(text[r["doc_id"]] or "")
            assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest() and set(base) <= set(pii.find_spans(text[r["doc_id"]] or "", field)[1])
    assert sorted((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in rows if r["doc_id"] == 20) == [(0, 0, 1, 0), (1, 1, 0, 1)]
    assert pii.find_private(none, pii.train(none)).count() == 0
    assert {r["spans"] for r in pii.find_private(docs.where("doc_id < 5"), pii.Field()).collect()} == {""}


# 12 collocations


def brute_counts(rows):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return f, n


def brute_collocations(rows, least, share, top):
    f, n = brute_counts(rows)
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        good = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            good.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(good)[:top])]
    return sorted(out)


def small_texts(seed, n=300):
    rng = random.Random(seed)
    passage = "once upon a time there was a very small house; and nobody knew"
    rows = []
    for _ in range(n):
        words = [rng.choices(["the", "of", "a", "Red", "car", "b\x01c", "éa", "x", f"r{rng.randint(0, 99)}"], [9, 7, 5, 4, 4, 2, 2, 3, 1])[0] for _ in range(rng.randint(0, 14))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", ""]) for w in words)
        rows.append((text + (passage if rng.random() < 0.1 else ""), rng.choice(["en", "en", "de", None])))
    return rows


@pytest.mark.parametrize(("seed", "least", "share", "top"), [(1, 2, 80, 2000), (2, 5, 80, 7), (3, 3, 30, 50)])
def test_collocations_against_brute_force(spark, seed, least, share, top):
    rows = small_texts(seed)
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = collocations.collocations(docs, least, share, top).collect()
    assert sorted(tuple(r) for r in got) == brute_collocations(rows, least, share, top)


def test_counts_flow_from_edges_and_piece_ends(spark):
    rows = small_texts(4)
    phrases, totals = collocations.phrase_counts(spark.createDataFrame(rows, "text string, lang string"), 2)
    f, n = brute_counts(rows)
    assert {(r["lang"], r["phrase"]): (r["words"], r["f"]) for r in phrases.collect()} == {(lang, " ".join(p)): (len(p), a) for lang, c in f.items() for p, a in c.items() if a >= 2}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {k: v for k, v in n.items() if v}


def test_unary_paths_are_compacted(spark):
    rows = [("w1 w2 w3 w4 w5 w6 w7 w8 w9", "en")] * 3 + [("w1 w2 w3 w4 w5", "en")] * 2 + [("a b c d", "de")] * 2
    phrases, _ = collocations.phrase_counts(spark.createDataFrame(rows, "text string, lang string"), 2)
    assert {(r["lang"], r["path"], r["edges"], r["weight"]) for r in collocations.compact_paths(phrases).collect()} == {
        ("en", "w1 w2 w3 w4 w5", 2, 5), ("en", "w3 w4 w5 w6 w7 w8 w9", 4, 3), ("de", "a b c d", 1, 2),
    }


def test_sums_cross_batches():
    import pyarrow as pa

    words = ["a b c d", "a b c e", "a b c e", "a b x", "c d"]
    rows = [("en", w, " ".join(w.split()[:2]), " ".join(w.split()[:3]), n) for w, n in zip(words, [5, 1, 2, 4, 9])]
    for size in (1, 2, 5):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "phrase", "two", "three", "n"), r)) for r in rows[i : i + size]]) for i in range(0, 5, size)]
        got = {(r["phrase"], r["words"]): r["f"] for b in collocations._flows(1)(iter(batches)) for r in b.to_pylist()}
        assert got == {("a b c d", 4): 5, ("a b c e", 4): 3, ("a b c", 3): 8, ("a b x", 3): 4, ("a b", 2): 12, ("c d", 2): 9}


def test_collocations_of_odd_rows(spark, odd, none):  # noqa: F811
    rows = [(r["text"], r["lang"]) for r in odd.collect()]
    docs = odd.withColumn("phrase", F.lit(1)).withColumn("n", F.lit(1))
    assert sorted(tuple(r) for r in collocations.collocations(docs, 2).collect()) == brute_collocations(rows, 2, 80, 2000)
    assert collocations.collocations(none).count() == 0


# 13 conversation repair


def exhaustive(rows):
    best = (2 * len(rows), "D" * len(rows))

    def go(i, state, cost, audit, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and state in (0, 3):
            best = min(best, (cost, audit))
        if inserts < 2:
            go(i, conversation_repair.NEXT[state], cost + 5, audit + "I", inserts + 1)
        if i < len(rows):
            initial, gone, cut = rows[i]
            go(i + 1, state, cost + 2, audit + "D", 0)
            if not gone:
                kept = {"0s": 1, "0u": 2, "1u": 2, "3u": 2, "2a": 3}.get(f"{state}{initial}")
                if kept is not None:
                    go(i + 1, kept, cost + 5 * cut, audit + "K", 0)
                go(i + 1, conversation_repair.NEXT[state], cost + 1 + 5 * cut, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return best


def test_cheapest_edits_against_enumeration_whole_and_in_stretches():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice("suaaux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
        whole = conversation_repair.Repair()
        for r in rows:
            whole.feed(*r)
        found = whole.results()
        wanted = exhaustive(rows)
        assert min(x for x in (found[0], found[3]) if x) == wanted
        cuts = [0, *sorted(rng.randint(0, len(rows)) for _ in range(2)), len(rows)]
        tables = []
        for a, b in zip(cuts, cuts[1:]):
            parts = [conversation_repair.Repair(s) for s in range(4)]
            for r in rows[a:b]:
                for p in parts:
                    p.feed(*r)
            tables.append([p.results() for p in parts])
        assert conversation_repair.joined(tables) == wanted


@pytest.mark.parametrize("prime", [5, 7, (1 << 61) - 1])  # small primes: nearly all hashes collide
def test_audit_order_survives_collisions(prime):
    rng, audits = random.Random(4), conversation_repair.Audits(prime)
    texts = ["".join(rng.choice("DIKR") for _ in range(rng.randint(0, 12))) for _ in range(60)]
    nodes, known = [], {"": 0}
    for t in texts:
        for k in range(1, len(t) + 1):
            if t[:k] not in known or rng.random() < 0.3:  # some prefixes are shared, others are copies
                known[t[:k]] = audits.add(known[t[: k - 1]], t[k - 1])
        nodes.append(known[t])
    for s, a in zip(texts, nodes):
        assert audits.spell(a) == s
        for t, b in zip(texts, nodes):
            assert audits.less(a, b) == (s < t)


def brute_repair(rows):
    """rows: (turn, role, text) after damage, in order."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    seen, states = set(), []
    for i, (_, role, text) in enumerate(rows):
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            out[fault] += 1
        if i and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au"):
            out["illegal"] += 1
        states.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    out["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    out["cost"], out["audit"] = exhaustive(states)
    left, roles, i = [], "", 0
    for e in out["audit"]:
        role = rows[i][1] if e == "K" else "assistant" if roles[-1:] == "u" else "user"
        if e != "D":
            left.append(f"{role}:{'' if e == 'I' else rows[i][2]}")
            roles += role[:1]
        i += e != "I"
    assert re.fullmatch("(s?(ua)+)?", roles)
    out["repaired_sha256"] = hashlib.sha256("\n".join(left).encode()).hexdigest()
    return out


def test_repair_of_odd_conversations(spark):
    import zlib

    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "and then", " ", "", None, "é.\n", "a.b"])) for c in [*range(30), None, -5] for t in rng.sample([None, *range(-1, 9)], rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")).withColumn("copies", F.lit(9)).withColumn("digest", F.lit(1))
    after = {}
    for c, t, role, text in rows:
        after.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        after[c] += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["conv_id"]: r.asDict() for r in conversation_repair.damage_and_repair(df).collect()}
        assert got.keys() == after.keys()
        for c, them in after.items():
            wanted = brute_repair(sorted(them, key=lambda r: (r[0] is not None, r[0])))
            assert {k: got[c][k] for k in wanted} == wanted, c
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert conversation_repair.damage_and_repair(df.where("false")).count() == 0


def test_a_long_conversation_is_cut_over_tasks(spark):
    n = 4000
    rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(1).alias("copies"))
    copied = rows.unionByName(rows.withColumn("turn", F.col("turn") + 100_000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    row = conversation_repair.repair(copied, copied).head()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert (row["duplicate"], row["illegal"], row["cost"], row["gaps"]) == (n, 0, 2 * n, 100_000 - n) and row["audit"] == "K" * n + "D" * n
    text = "\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:t{i}." for i in range(n))
    assert row["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# 2 pages without an article, malformed markup


@pytest.mark.parametrize("html", ["<a " * 350_000, "x<b " * 250_000, "<div>" * 100_000 + "</p>" * 100_000, '<a x="' * 150_000, "<a " * 200_000 + 'x=">"', "<" * 1_000_000, "<!--" * 200_000, "<center>" * 50_000 + "<td>" * 50_000])
def test_malformed_pages_take_linear_time(html):
    import time

    from countloom.llm import html_text

    start = time.process_time()
    html_text.PageNodes(html)
    assert time.process_time() - start < 4


def test_markup_that_does_not_end():
    from countloom.llm import html_text

    text = lambda h: html_text.PageNodes(h).text([True] * 1000)
    assert text("<p>a < b and c<d") == "a < b and c<d"
    assert text('<p title="x>y">one</p><p class="open>two</p>three') == "one\n\ntwo\n\nthree"
    assert text("<p>one<!-- two</p>three") == "one"
    assert text("<p>one</p><? php ?><!doctype html>two") == "one\n\ntwo"


def page_without_article(rng, k):
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 9)))
    said = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    body = [said(rng.randint(25, 60)) for _ in range(rng.randint(4, 7))]
    links = "".join(f"<li><a href='/{word()}'>{word()}</a></li>" for _ in range(rng.randint(5, 9)))
    html = f"<html><body><div class='menu'><ul>{links}</ul></div><div class='wrap'><div class='story'>{''.join(f'<p>{b}</p>' for b in body)}</div></div><div class='footer'>{said(3)} <a href='/'>{word()}</a></div></body></html>"
    return k, html, "\n\n".join(body)


def test_pages_without_article_or_main_are_not_lost(spark):
    from countloom.llm import html_text

    rng = random.Random(3)
    pages = [page_without_article(rng, k) for k in range(60)]
    df = spark.createDataFrame([(None, "u", h) for _, h, _ in pages[:30]] + [(k, "u", h) for k, h, _ in pages[30:]], "page_id long, url string, html string")
    trees = html_text.train(df, sample=40)
    found = {r["page_id"]: r["text"] for r in html_text.main_text(df, trees).where("page_id IS NOT NULL").collect()}
    shares = []
    for k, _, body in pages[30:]:
        lines = set(body.split("\n\n"))
        shares.append(len(lines & set(found[k].split("\n\n"))) / len(lines))
    assert np.mean(shares) > 0.9, shares
