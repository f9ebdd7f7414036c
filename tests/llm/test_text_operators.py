import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quintil.llm import decontaminate, lines, passages, pieces, ppm, quality, rules, simhash
from quintil.llm.components import smallest_reachable
from quintil.llm.queries import model_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
END = 1 << 62


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# SimHash


def brute_fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs):
    """(id, fingerprint) to smallest id reachable, for each row."""
    prints = sorted({f for _, f in pairs})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return [(i, f"{f:016x}", least.get(root(f))) for i, f in pairs]


def test_simhash_against_all_pairs(docs, corpus):
    expected = brute_components([(i, brute_fingerprint(t)) for i, t, *_ in corpus])
    got = rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")
    assert got == sorted(expected, key=repr)


def test_simhash_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(3)
    bits = [int(b) for b in rng.integers(0, 1 << 63, 60)]
    for b in list(bits):
        near = b
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            near ^= 1 << int(bit)
        bits.append(near)
    signed = sorted({b - (1 << 64) if b >> 63 else b for b in bits})
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(b,) for b in signed], "bits long")).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert found == expected and expected


def test_golay_words_two_apart_share_a_codeword():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 5000)
    b = a ^ (1 << rng.integers(0, 23, 5000)) ^ (1 << rng.integers(0, 23, 5000))
    left, right = (set(zip(*(x.tolist() for x in simhash.codewords(v)))) for v in (a, b))
    assert {row for row, _ in left & right} == set(range(5000))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300), (None, 5)]
    got = dict(rows_of(smallest_reachable(spark.createDataFrame(edges, "x long, y long")), "u", "v"))
    assert got == {**{i: 1 for i in range(2, 41)}, **{i: 100 for i in range(101, 160)}, 300: 299}


def test_simhash_empty(none):
    assert simhash.near_duplicates(none).count() == 0


# Quality


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        text = f"A plain sentence number {i} about something, as people write. It has words of all kinds." if good else "BUY!! $$$ NOW!! " * (i % 5 + 3)
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(900, ""), (901, None), (None, "A plain sentence about something, as people write.")]
    labels += [(5000, 1, 0), (3, None, 0), (4, 7, 0), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_separates_held_out_documents(labelled):
    docs, labels = labelled
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(got) == 303
    for i in range(300):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].predicted == int(i % 3 > 0) == int(got[i].score >= 0.3)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].predicted == 1


def test_quality_without_both_labels(labelled, none):
    docs, labels = labelled
    assert {r.score for r in quality.score(docs, labels.where("quality = 1")).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0


def test_quality_bound_on_labels(labelled):
    docs, labels = labelled
    assert quality.training_sample(docs, labels, "doc_id", "text", 40).count() == 40


# Passages


def brute_passages(corpus):
    first = {}
    for i, t, *_ in corpus:
        w = words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, END), END if i is None else i)
    out = []
    for i, t, *_ in corpus:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (END if i is None else i):
                gone.update(range(k, k + 13))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def test_passages_against_all_windows(docs, corpus):
    expected = brute_passages(corpus)
    assert rows_of(passages.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept") == expected
    assert sum(e[2] for e in expected) > 100


def test_passage_spans(docs):
    for r in passages.remove_repeats(docs).collect():
        spans = list(zip(r.removed[::2], r.removed[1::2]))
        assert sum(b - a for a, b in spans) == r.n_removed and spans == sorted(spans)


def test_passages_empty(none):
    assert passages.remove_repeats(none).count() == 0


def test_automaton_compares_words_where_hashes_agree():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    run = [f"w{i}" for i in range(20)]
    texts = [" ".join(run), " ".join(["x", *run[3:18], "y", *run[:13]]), "", " ".join(rng.choice("ab") for _ in range(60)), " ".join(run)]
    held = passages.Words(pa.table({"doc_id": pa.array([1, 2, 3, 4, 5]), "text": pa.array(texts)}))
    places = np.arange(8)
    window = {tuple(run[i : i + 13]): i for i in range(8)}
    words = [w for t in texts for w in t.split()]
    automaton = passages.Automaton(held, places, places, np.array([window.get(tuple(words[i : i + 13]), -1) for i in range(len(words))]))
    least = np.ones(8, np.int64)
    split = [t.encode().split() for t in texts]
    assert [automaton.covered(d, split[d], least, d + 1) for d in range(5)] == [[], [1, 16, 17, 30], [], [], [0, 20]]
    other = [b"z" if w == b"w9" else w for w in split[4]]
    assert automaton.covered(4, other, least, 5) == []


# SentencePiece


def test_pieces_against_the_library(docs, corpus):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    expected = []
    for i, t, *_ in corpus:
        ids = library.encode(t or "", add_eos=True)
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), library.decode(ids))]
        expected.append((i, len(ids), *digest, 0))
    got = pieces.encode(docs, model_path())
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_differing") == sorted(expected, key=repr)
    assert {"lang", "score"} <= set(got.columns) and got.columns.count("n_tokens") == 1


def test_pieces_agenda_for_long_and_odd_segments():
    model = pieces.segmenter(model_path())
    for text in ["x" * 3000, "ab" * 700 + "é" * 90, " " * 50, "▁▁ ▁a", "\n\n\na", "日本語" * 40, "\x00\x01", "<s></s>", "\U0001f600" * 60]:
        ids, decoded, wrong = model.encode_batch([text])[0]
        sure = model.library.encode(text, add_eos=True)
        assert ids == " ".join(map(str, sure)) and decoded == model.library.decode(sure) and wrong == 0


def test_pieces_output_columns(docs, none):
    row = pieces.encode(docs.where("doc_id = 133"), model_path(), with_output=True).first()
    assert row.decoded == "one two" and len(row.token_ids) == row.n_tokens
    assert pieces.encode(none, model_path()).count() == 0


# Decontamination


def brute_distance(pattern, text):
    before = [0] * (len(text) + 1)
    for i, a in enumerate(pattern):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


@pytest.fixture(scope="module")
def benchmark(spark, corpus):
    texts = [corpus[5][1], corpus[6][1][:150], "Not in any of these documents at all, whatever one does.", None, "too short", corpus[5][1]]
    return [(i, t) for i, t in enumerate(texts)]


def test_decontamination_against_all_distances(spark, corpus, benchmark):
    item = benchmark[1][1]
    edited = item[:20] + "zz" + item[23:60] + item[62:90] + "qqq" + item[91:]
    extra = [(700, f"Before it. {edited} And after it."), (701, item.upper().replace(" ", ",  ")), (702, None), (None, item)]
    rows = [(i, t) for i, t, *_ in corpus] + extra
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, tests).collect()}
    expected = {}
    for i, t in rows:
        for j, other in benchmark:
            plain, text = decontaminate.normal(other), decontaminate.normal(t)
            if len(plain.split()) >= decontaminate.MIN_WORDS and (d := brute_distance(plain, text)) <= int(len(plain) * 0.1):
                expected[i, j] = min(d, expected.get((i, j), d))
    assert {k: r.distance for k, r in got.items()} == expected and (700, 1) in expected
    place = got[701, 1]
    assert decontaminate.normal(extra[1][1][place.start : place.end]) == decontaminate.normal(benchmark[1][1])


def test_decontamination_without_items(spark, docs, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, nothing).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")).count() == 0


# Scores


def brute_ppm(corpus, order=ppm.ORDER):
    train = [t or "" for i, t, *_ in corpus if zlib.crc32(str("null" if i is None else i).encode()) % 10]
    counts = [{} for _ in range(order + 1)]
    for t in train:
        data = ppm.START + t.encode() + ppm.END
        for k in range(order, len(data)):
            context = data[k - order : k]
            top = counts[order].setdefault(context, Counter())
            top[data[k]] += 1
    for o in range(order - 1, -1, -1):
        for context, successors in counts[o + 1].items():
            below = counts[o].setdefault(context[1:], Counter())
            for s in successors:
                below[s] += 1
    tokens = Counter(w for t in train for w in words(lower(t)))
    n, v = sum(tokens.values()) + len(train), len(tokens) + bool(train)

    def chance(context, symbol):
        out, excluded = 0.0, set()
        for o in range(order, -1, -1):
            seen = counts[o].get(context[order - o :], {})
            left = {s: c for s, c in seen.items() if s not in excluded}
            total = sum(left.values())
            if symbol in left:
                return out + math.log10((left[symbol] - ppm.DISCOUNT) / total)
            if total:
                out += math.log10(ppm.DISCOUNT * len(left) / total)
            excluded |= set(seen)
        return out - math.log10(256 - len(excluded))

    out = {}
    for i, t, *_ in corpus:
        data = ppm.START + (t or "").encode() + ppm.END
        w = words(lower(t))
        base = sum(math.log10((tokens[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + math.log10((len(train) + 0.1) / (n + 0.1 * (v + 1)))
        score = sum(chance(data[k - order : k], data[k]) for k in range(order, len(data)))
        out[i] = (len(w) + 1, sum(tokens[x] > 0 for x in w) + bool(train), n, base, score)
    return out


def test_ppm_against_a_plain_trie(docs, corpus):
    expected = brute_ppm(corpus)
    got = ppm.score(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        want = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)


def test_ppm_is_a_distribution():
    texts = ["abracadabra", "abba", ""]
    keys, counts = ppm.distinct_sequences(texts)
    pairs = np.zeros(1 << 16, np.int64)
    inner, n = ppm.counted([ppm.counted([keys & np.uint64(0xFFFFFF)])[0] & np.uint64(0xFFFF)])
    pairs[inner.astype(np.int64)] = n
    trie = ppm.Trie(keys, counts, pairs)
    for context in (b"\n\n\n\n\n", b"\nabra", b"zzzzz", b"racad"):
        asked = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (10 ** trie.log10(asked)).sum() == pytest.approx(1)


def test_ppm_without_training_rows(spark, none):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = ppm.score(spark.createDataFrame([(i, "abc") for i in held], "doc_id long, text string")).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert {round(r.score, 9) for r in got} == {round(-4 * math.log10(256), 9)}
    assert ppm.score(none).count() == 0


# Lines


def brute_lines(corpus, least):
    docs = sorted({(END if i is None else i, t) for i, t, *_ in corpus if t is not None}, key=lambda d: (d[0], simple_hash(d[1])))
    first, runs = {}, {}
    for i, t in docs:
        seq = [(k, x) for k, x in enumerate(t.split("\n")) if words(x)]
        runs[i, t] = seq
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                content = tuple(x for _, x in seq[a:b])
                if sum(len(words(x)) for x in content) >= least:
                    first.setdefault(content, (i, simple_hash(t), a))
    out = []
    for i, t, *_ in corpus:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        at = END if i is None else i
        seq, gone = runs[at, t], set()
        for a in range(len(seq)):
            for b in range(a + 1, len(seq) + 1):
                content = tuple(x for _, x in seq[a:b])
                if content in first and first[content] < (at, simple_hash(t), a):
                    gone.update(k for k, _ in seq[a:b])
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(seq), len(gone)))
    return sorted(out, key=repr)


def simple_hash(text):
    """The signed XXH64 with which rows that share a doc_id are ordered."""
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("least", [1, 7, 50])
def test_lines_against_all_runs(docs, corpus, least):
    got = lines.remove_repeated_lines(docs, min_words=least)
    assert rows_of(got, "doc_id", "text", "n_lines", "n_removed") == brute_lines(corpus, least)
    assert got.columns[:7] == docs.columns


def test_lines_within_a_document_and_empty(spark, none):
    text = "\n".join(["a b c", "d e f", "a b c", "d e f", "", "x"])
    row = lines.remove_repeated_lines(spark.createDataFrame([(1, text)], "doc_id long, text string"), min_words=6).first()
    assert (row.text, row.n_removed) == ("a b c\nd e f\n\nx", 2)
    assert lines.remove_repeated_lines(none).count() == 0


# Rules


def test_rules_counts_and_verdicts(docs, corpus):
    got = rules.judge(docs)
    expected = []
    for i, t, *_ in corpus:
        t = t or ""
        w = words(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeats = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        full = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(repeats) > 20 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(repeats), failed))
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert rows_of(got, *columns) == sorted(expected, key=repr)
    assert all(not (r.kept and r.base_failed) for r in got.collect())


def test_rules_reject_outliers_only(spark, none):
    rng = np.random.default_rng(2)
    names = "alder birch cedar dogwood elm fir gingko hazel ivy juniper".split()
    clean = [(i, " ".join(rng.choice(names, 80)), "en", "a") for i in range(200)]
    junk = [(1000 + i, " ".join(w + "###$$$" for w in rng.choice(names, 80)), "en", "a") for i in range(20)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i].kept for i, *_ in junk)
    assert sum(got[i].kept for i, *_ in clean if not got[i].base_failed) == sum(not got[i].base_failed for i, *_ in clean) > 150
    assert rules.judge(none).count() == 0


def test_chi_square_quantile():
    assert rules.chi2_quantile(0.05, 6) == pytest.approx(12.591587, abs=1e-5)
    assert rules.chi2_quantile(0.25, 8) == pytest.approx(10.218855, abs=1e-5)


def test_many_lines_in_one_text(spark):
    import time

    text = "\n".join(["one two three"] * 30_000)
    docs = spark.createDataFrame([(1, text), (2, "\n".join(f"line {i} of many" for i in range(30_000)))], "doc_id long, text string")
    start = time.time()
    found = {r.doc_id: r for r in lines.remove_repeated_lines(docs).collect()}
    assert time.time() - start < 60
    assert found[2].n_removed == 0 and found[1].n_lines == 30_000
    # Every window but the first starts later, and together they hold all lines but the first.
    assert found[1].n_removed == 30_000 - 1
