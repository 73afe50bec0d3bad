"""Vector codes, source divergence and sequence packing against brute force, on awkward tables and on those of the driver."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_operators import prose
from tests.oracle import connect, difference
from verdictflow.llm import divergence, packing, vector_codes
from verdictflow.llm.catalog import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert difference(queries()[name](spark, SF), connect(SF), oracle_sql()[name]) == ""


# Vector codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (vec_id, vector, label) in any order; the contract word by word."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for _, v, _ in kept:
                of[best(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e])] if of[e] else c for e, c in enumerate(books[p])]
    out, by_label = [], Counter()
    for i, v, lab in kept:
        found = [best(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter((i, c, e, by_label[lab], digest) for i, c, e, lab in out)


VECTORS = "vec_id long, embedding array<float>, label int, v string, n int, same int, times int, code int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1, 2, 3, 4) for i, v, lab in rows], VECTORS).repartition(3)


def test_vector_codes(spark):
    r = random.Random(5)
    rows = [(i, [float(np.float32(r.gauss(0, 0.02))) for _ in range(8)], r.choice([None, 1, 2])) for i in range(400)]
    rows += [(400, None, 1), (401, [None] + [0.0] * 7, 1), (402, [float("nan")] * 8, 2), (403, [float("-inf")] + [0.0] * 7, 2)]
    rows += [(404, rows[0][1], 1), (404, rows[0][1], 1), (None, rows[1][1], None), (405, [-1e-9] * 8, 3)]
    out = vector_codes.compress(vectors(spark, rows)).collect()
    assert Counter(map(tuple, out)) == brute_codes(rows)
    assert not vector_codes.compress(vectors(spark, rows).where("false")).collect()
    few = vector_codes.compress(vectors(spark, rows[:3])).collect()  # fewer vectors than entries
    assert Counter(map(tuple, few)) == brute_codes(rows[:3]) and {x["error"] for x in few} == {0}


def test_vectors_of_another_length(spark):
    rows = [(1, [0.5] * 8, 1), (2, [0.25] * 8, 1), (3, [1.0] * 5, 1), (4, [], 1), (0, [1.0], 1)]
    out = {x["vec_id"]: x for x in vector_codes.compress(vectors(spark, rows)).collect()}
    assert (out[1]["error"], out[2]["error"], out[1]["label_error"]) == (0, 0, 0)
    assert all(out[i]["code"] is None and out[i]["error"] is None for i in (0, 3, 4))


def test_nearest_with_ties_and_repeats():
    r = np.random.default_rng(3)
    for d, k, top in ((1, 5, 3), (3, 7, 2), (16, 256, 4), (16, 256, 900)):
        x, book = r.integers(-top, top, (300, d)), r.integers(-top, top, (k, d))
        whole = ((x[:, None] - book[None]) ** 2).sum(2)
        at, distance = vector_codes.nearest(x, book)
        assert (at == whole.argmin(1)).all() and (distance == whole.min(1)).all()


def test_sums_of_many_labels(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 50, i) for i in range(600)], "vec_id long, label int, error long")
    want = Counter()
    for x in rows.collect():
        want[x["label"]] += x["error"]
    for few in (1000, 3):  # broadcast; then hot labels apart from the others
        out = vector_codes.with_sum_of_equals(rows, "label", "error", "label_error", few=few, hot=20).collect()
        assert len(out) == 600 and all(x["label_error"] == want[x["label"]] for x in out)


# Source divergence


def brute_audit(rows, least, ranks):
    """rows: (lang, source, text)."""
    terms = lambda t: re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    groups, in_docs, totals, counts = defaultdict(set), Counter(), Counter(), Counter()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", terms(text)
        groups[lang].add(source)
        in_docs.update((lang, t) for t in set(found))
        totals.update((lang, t) for t in found)
        counts.update((lang, source, t) for t in found)
    out = []
    for lang, sources in groups.items():
        kept = [t for (a, t), n in in_docs.items() if a == lang and n >= least]
        v = len(kept)
        p_of = lambda count, n: 1 + 1_000_000_000 * (count + 5) // (n + 5 * v)
        q = {t: p_of(totals[lang, t], sum(totals[lang, x] for x in kept)) for t in kept}
        p = {s: {t: p_of(counts[lang, s, t], sum(counts[lang, s, x] for x in kept)) for t in kept} for s in sources}
        for s in sources:
            pair = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(p[s][t] - q[t], t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return Counter(out)


def test_audit(spark):
    r = random.Random(9)
    words = [*"abcdefgh", "É", "é", "ＡＢ", "straße", "Ab", "aB", "zz", "Ω"]
    rows = [(r.choice(["en", "de", None]), f"s{r.randint(0, 11)}", " ".join(r.choice(words) + r.choice(["", "-", "1", "\n"]) for _ in range(r.randint(0, 30)))) for _ in range(300)]
    rows += [("en", None, None), ("en", "", "a"), ("en", "empty", ""), ("xx", "alone", "a b"), ("yy", "p", "q w"), ("yy", "r", None), ("fr", "long", prose(4, 20_000)), ("fr", "s0", prose(5, 300))] + [rows[0]] * 3
    docs = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "lang string, source string, text string, term int, chunk int, n int").repartition(4)
    for chunk, slab, block in ((4096, 16, 32), (3, 2, 4)):  # then many chunks, slabs and tiles
        out = divergence.audit(docs, least=4, ranks=3, chunk=chunk, slab=slab, block=block).collect()
        assert Counter(map(tuple, out)) == brute_audit(rows, 4, 3)
    assert not divergence.audit(docs.where("false")).collect()


def test_probabilities_of_large_counts():
    counts = np.array([0, 7, 10**12, 3 * 10**12], np.int64)
    assert divergence.probabilities(counts, 4 * 10**12, 10**7).tolist() == [1 + 10**9 * (int(c) + 5) // (4 * 10**12 + 5 * 10**7) for c in counts]


def test_kept_terms_beyond_a_broadcast(spark):
    rows = [("en", f"s{i % 5}", "a b c " * (i % 4)) for i in range(60)]
    counts = divergence.count_terms(spark.createDataFrame(rows, "lang string, source string, text string").repartition(6), size=1)
    terms = divergence.kept_terms(counts, 1, 2)
    for few in (0, 10):
        found = Counter()
        for x in divergence.pack_counts(counts, terms, few).collect():
            found[x["source"]] += sum(x["n"])
        assert found == Counter({f"s{k}": sum(3 * (i % 4) for i in range(60) if i % 5 == k) for k in range(5)})


# Sequence packing


def one_by_one(counts, capacity):
    """Residuals of all bins when items are placed singly, longest first, each in the feasible bin of the least residual norm."""
    cap = capacity.vector()
    asked = [sum((n, 1, n * n)[k] * c for n, c in counts.items()) / cap[k] for k in range(3)]
    weight = [a / (sum(asked) or 1) for a in asked]
    bins = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            fit = [i for i, b in enumerate(bins) if b[0] >= n and b[1] >= 1 and b[2] >= n * n]
            if not fit:
                bins.append(list(cap))
            i = min(fit, key=lambda i: (sum(w * (x / c) ** 2 for w, x, c in zip(weight, bins[i], cap)), bins[i])) if fit else len(bins) - 1
            bins[i] = [x - d for x, d in zip(bins[i], (n, 1, n * n))]
    return sorted(map(tuple, bins))


def contents(moves):
    bins, placed = defaultdict(list), []
    for m in moves:
        for x in range(m.first_item, m.last_item):
            bin_, within = divmod(x - m.first_item, m.each)
            bins[m.first_bin + bin_].append((m.offset + within * m.length, m.length))
            placed.append((m.length, x))
    return bins, placed


def test_best_fit_is_that_of_single_items():
    for seed in range(120):
        r = random.Random(seed)
        tokens = r.choice([7, 20, 64])
        capacity = packing.Capacity(tokens, r.choice([None, 2, 3, 5]), r.choice([None, tokens * tokens // 2]))
        longest = int(capacity.vector()[2] ** 0.5)
        counts = {n: r.randint(1, 12) for n in r.sample(range(1, longest + 1), r.randint(1, min(longest, 12)))}
        bins, placed = contents(packing.best_fit(counts, capacity))
        assert len(placed) == len(set(placed)) and Counter(n for n, _ in placed) == counts
        residuals = []
        for inside in bins.values():
            at = 0
            for offset, n in sorted(inside):
                assert offset == at
                at += n
            residuals.append(tuple(c - u for c, u in zip(capacity.vector(), (at, len(inside), sum(n * n for _, n in inside)))))
        assert sorted(residuals) == one_by_one(counts, capacity)
    assert packing.best_fit({}) == []
    with pytest.raises(ValueError):
        packing.best_fit({5: 1}, packing.Capacity(20, None, 24))


def test_moves_do_not_grow_with_the_items():
    r = random.Random(1)
    shape = {n: r.randint(1, 9) for n in range(1, 4097)}
    sizes = [len(packing.best_fit({n: c * times for n, c in shape.items()})) for times in (1, 1000, 1_000_000)]
    assert max(sizes) < 60_000 and sizes[2] < 1.5 * sizes[1]


TEXTS = [None, "", " \n\t ", "Hello, WORLD! it's 12 O'Clock", "É é é ́x ß İ  y\x0bz\x1cw", "<|endoftext|> a <|startoftext|>", "a" * 3000, prose(6, 20_000), prose(7, 700), prose(7, 700), "日本語 тест", "x\r\ny z"]


def test_packing(spark):
    rows = [(i, t, 1, 2, 3) for i, t in enumerate(TEXTS)] + [(0, None, 1, 2, 3), (None, "b", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, task int, place int, rank int").repartition(3)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    out = packing.pack(docs, with_ids=True).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for x in out:
        by_doc[x["doc_id"]].append(x)
        by_bin[x["sequence_id"]].append(x)
        assert x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) and len(x["ids"]) == x["length"] <= 4096
    for i, text in [(r[0], r[1]) for r in rows]:
        want = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        times = 2 if i == 0 else 1
        assert len(by_doc[i]) == times * -(-len(want) // 4096)
        for x in by_doc[i]:
            assert x["ids"] == want[x["start"] : x["start"] + x["length"]] and x["start"] == 4096 * x["piece"]
    total = 0
    for pieces in by_bin.values():
        at = 0
        for x in sorted(pieces, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 4096
        total += at
    assert len(by_bin) == -(-total // 4096)  # no packing has fewer
    joined = {r["sequence_id"]: r["ids"] for r in packing.sequences(packing.pack(docs, with_ids=True)).collect()}
    assert sum(map(len, joined.values())) == total
    assert not packing.pack(docs.where("false")).collect()
    limited = packing.pack(docs, packing.Capacity(256, documents=2, attention=80_000)).groupBy("sequence_id").agg({"length": "sum", "*": "count"}).collect()
    assert all(x["sum(length)"] <= 256 and x["count(1)"] <= 2 for x in limited)


def test_ids_by_word_are_those_of_the_text():
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.encode_special_tokens = True
    r = random.Random(3)
    pieces = [*"aZéßÉµªºİıΣςſʼnNg59.,;:!?'\"-_ \n\t\r\x0b\x1c\u0301\u00a0\u3000\u200d", "'s", "don't", "WORD.", "x?!", "ﬁ", "日", "Ǆ", "K", "😀", "<|endoftext|>", "the", "Straße,"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    coder = packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))
    for s in range(0, len(texts), 500):  # later blocks meet words that are known
        for t, ids in zip(texts[s : s + 500], coder.ids(texts[s : s + 500]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_of_the_documents(spark):
    out = queries()["op13_sequence_packing"](spark, SF).toPandas()
    ordered = out.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id")["length"].cumsum()
    assert (ends - ordered["length"] == ordered["offset"]).all() and ends.max() <= 4096
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 4096) + 1
