"""The training-data operators against brute force, and their odd inputs."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sqlloom.llm import chat, common, decontaminate, packing, quality, rules, secrets, sentences, simhash, suffix, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, row string"


def docs_of(spark, texts, ids=None):
    """Extra columns rid and row clash with names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", 0, 7, "r") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], SCHEMA).repartition(3)


rng = random.Random(3)
WORDS = "alpha beta gamma delta eps zeta eta theta é iota kappa Mira Jon".split()
prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(50)) + rng.choice(["", "", ".", ",\n"]) for _ in range(n))
ODD = [None, "", " ", "\n\n", "x", "word " * 3, "a" * 5000, "ab " * 900, "é" * 700, "<|endoftext|> a", "\x1c\x85　  z", "日本語のテキスト" * 50, "don't they'll  go\t\tnow"]


def odd_docs(spark):
    texts = [*ODD, prose(300), prose(20)]
    texts += [texts[-2], texts[-2], None]
    ids = [*range(len(texts) - 3), 3, None, None]
    return docs_of(spark, texts, ids), texts, ids


# --- packing ------------------------------------------------------------------------------------


def check_packed(found, tok, texts, capacity):
    by_sequence = collections.defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    want = collections.Counter()
    for i, text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    return len(by_sequence)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df, texts, ids = odd_docs(spark)
    found = packing.pack(df, capacity=64).collect()
    n = check_packed(found, tok, list(zip(ids, texts, strict=True)), 64)
    assert n <= 1.05 * -(-sum(r.length for r in found) // 64) + 2
    kept = packing.pack(df, capacity=64, keep_ids=True).collect()
    assert all(len(r.ids) == r.length for r in kept)
    assert packing.pack(df.limit(0)).count() == 0


def test_plan_is_best_fit():
    def one_by_one(lengths, capacity):
        bins = []
        for x in sorted(lengths, reverse=True):
            fit = [b for b in bins if b >= x]
            if fit:
                bins.remove(min(fit))
                bins.append(min(fit) - x)
            else:
                bins.append(capacity - x)
        return len(bins)

    for seed in range(30):
        r = random.Random(seed)
        lengths = [r.randrange(1, 41) for _ in range(r.randrange(1, 200))] + [40] * r.randrange(50)
        slots = packing.plan(dict(collections.Counter(lengths)), 40)
        sequences = {s[3] + i for s in slots for i in range(-(-s[2] // s[4]))}
        assert len(sequences) == one_by_one(lengths, 40)
        assert sum(s[2] for s in slots) == len(lengths)


# --- secrets ------------------------------------------------------------------------------------


def test_secrets(spark):
    many = " ".join(f"token=abcdefghijkl{i}" for i in range(700))
    texts = [
        'x password: "Abc123defghi" y', "API_KEY = short", "token: password: abcdefghijklmnop", "AKIA" + "Z9" * 8 + " AKIAX", "é" * 5 + " " + "0123456789abcdef0" + " zz", None, "", many,
        "live Zx9" + "qW3" * 7 + " end", "copied Aa1" + "bB2" * 7, "copied Aa1" + "bB2" * 7, "copied Aa1" + "bB2" * 7, "SeCret='aaaaaaaaaaaa'",
    ]
    found = {r.doc_id: r for r in secrets.digest(docs_of(spark, texts)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        want, n = [], [0, 0, 0]
        base = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"AKIA[A-Z0-9]+", "[0-9a-f]+")
        for k, (pattern, least) in enumerate(zip(base, (12, 18, 16), strict=True)):
            for m in re.finditer(pattern, text or ""):
                if len(m[1] if k == 0 else m[0]) >= least:
                    want.append((m.start(), k, f"{secrets.KINDS[k]}:{m.start()}:{m.end()}"))
                    n[k] += 1
        said = ",".join(w[2] for w in sorted(want))
        r = found[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(n)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) <= set(r.spans.split(",")) or not said
    assert "mixed" in found[8].spans and found[8].n_live == 1
    assert found[9].spans == "" and found[9].n_example == 1  # three owners hold it
    masked = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert masked[0] == "x <assign>\" y" and masked[5] is None and masked[1] == texts[1]
    assert masked[4] == "é" * 5 + " <hex> zz" and masked[7] == " ".join(["<assign>"] * 700)
    df, texts, _ = odd_docs(spark)
    assert secrets.digest(df).count() == secrets.redact(df).count() == len(texts)
    assert secrets.redact(df).columns == df.columns and secrets.digest(df.limit(0)).count() == 0


def test_one_owner_with_many_repositories(spark):
    token = "Zx9" + "qW3" * 7
    rows = [(i, f"note {token} end", "hot") for i in range(20)] + [(100 + i, f"key {token[::-1]} end", "other") for i in range(3)] + [(200, token[::-1] + " x", None), (200, token[::-1] + " x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    found = {r.doc_id: r for r in secrets.digest(df).collect()}
    assert all(found[i].spans == "" and (found[i].n_example, found[i].most_owners, found[i].most_repositories) == (1, 1, 20) for i in range(20))
    assert all("mixed" in found[100 + i].spans and (found[100 + i].most_owners, found[100 + i].most_repositories) == (2, 4) for i in range(3))
    assert {r.text for r in secrets.redact(df).filter("source = 'hot'").collect()} == {f"note {token} end"}


def test_very_many_candidates_in_a_long_text(spark):
    own = random.Random(6)
    mixed = [f"Ab{i:05d}" + "qW3xZ" * 3 for i in range(25_000)]
    text = " é😀 ".join(x for i, m in enumerate(mixed) for x in (m, f"token={own.getrandbits(80):020x}z{m}")) + " tail " * 200_000
    texts = [text, "password=" + "a" * 5000 + " b", "x" * 4090 + " token=" + "b1" * 3000 + " z", None]
    found = {r.doc_id: r for r in secrets.scan(docs_of(spark, texts)).collect()}
    assert [len(found[i].base) for i in range(4)] == [sum(1 for p in (secrets.ASSIGN, secrets.HEX) for _ in re.finditer(p, t or "")) for t in texts]
    assert sum(s.kind == 3 for s in found[0].spans) == 25_000
    out = {r.doc_id: r.text for r in secrets.redact(docs_of(spark, texts)).collect()}
    assert out[0] == " é😀 ".join(["<mixed>", "<assign>"] * 25_000) + " tail " * 200_000
    assert [out[i] for i in (1, 2, 3)] == ["<assign> b", "x" * 4090 + " <assign> z", None]


# --- near-duplicates ----------------------------------------------------------------------------


def component_of(fps, k):
    u = np.unique(np.array(fps, np.uint64))
    parent = list(range(len(u)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= k), strict=True):
        parent[max(root(i), root(j))] = min(root(i), root(j))
    return {int(x): root(i) for i, x in enumerate(u)}


@pytest.mark.parametrize("hot", [simhash.HOT, 8])
def test_simhash(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    base = [prose(60) for _ in range(12)]
    texts = [*ODD, *base, *base[:4]]
    for b in base:
        w = b.split()
        for _ in range(6):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    found = simhash.cluster(docs_of(spark, texts)).collect()
    assert len(found) == len(texts)
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in texts[r.doc_id] or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        assert int(r.fingerprint, 16) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    of = component_of([int(r.fingerprint, 16) for r in found], 3)
    least = {}
    for r in found:
        c = of[int(r.fingerprint, 16)]
        least[c] = min(least.get(c, 1 << 60), r.doc_id)
    assert all(r.component_id == least[of[int(r.fingerprint, 16)]] for r in found)
    df = docs_of(spark, texts)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    df, texts, _ = odd_docs(spark)
    assert simhash.cluster(df).count() == len(texts) and simhash.deduplicate(df).count() < len(texts)
    assert simhash.cluster(df.limit(0)).count() == 0


def test_forest_against_all_pairs():
    r = np.random.default_rng(5)
    for bits in (64, 12):
        v = r.integers(0, 1 << min(bits, 63), 400, dtype=np.uint64)
        near = v ^ (np.uint64(1) << r.integers(0, 64, 400).astype(np.uint64))
        v = np.unique(np.concatenate([v, near]))
        a, b = simhash.forest(v)
        want, got = component_of(v, 3), {}
        parent = {int(x): int(x) for x in v}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            assert (x ^ y).bit_count() <= 3
            parent[max(root(x), root(y))] = min(root(x), root(y))
        for x in parent:
            got.setdefault(root(x), set()).add(x)
        groups = {}
        for x, c in want.items():
            groups.setdefault(c, set()).add(x)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_on_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)]
    rng.shuffle(edges)
    found = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(found) == 301 + 501 and all(v == (0 if k < 1000 else 1000) for k, v in found.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- substring dedup ----------------------------------------------------------------------------


def repeated_bytes(docs, span):
    count = collections.Counter()
    for t in docs:
        count.update(t[i : i + span] for i in range(len(t) - span + 1))
    out = []
    for t in docs:
        hit = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                hit[i : i + span] = b"\1" * span
        kept = bytes(b for b, f in zip(t, hit, strict=True) if not f)
        runs = sum(1 for i in range(len(hit)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("repeat_ids", [False, True])
def test_suffix_dedup(spark, repeat_ids):
    passages = [prose(n) for n in (45, 57, 60, 70, 90, 130, 200)]
    texts = list(ODD)
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            p, kind = rng.choice(passages), rng.random()
            if kind < 0.7:
                at = rng.randrange(len(p))
                parts.append(p if kind < 0.3 else p[at // 2 :] if kind < 0.5 else p[:at] if kind < 0.6 else p[:at] + "#" + p[at + 1 :])
            parts.append(prose(rng.randrange(1, 60)))
        texts.append(" ".join(parts))
    texts += [texts[-1], texts[-1], "q" * 401, "r" * 400, texts[-2][:900]]
    ids = [1 if repeat_ids and i % 4 else None if repeat_ids else i for i in range(len(texts))]
    found = suffix.remove_repeats(docs_of(spark, texts, ids)).collect()
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == repeated_bytes([(t or "").encode() for t in texts], 400)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert suffix.remove_repeats(docs_of(spark, ["a"]).limit(0)).count() == 0


def test_suffix_dedup_of_periodic_and_long_texts(spark):
    own = random.Random(12)
    noise = lambda n: "".join(own.choice("abcdefghij ") for _ in range(n))
    line = "one line that comes again and again\n"
    texts = [noise(300) + "x" * 3000 + noise(200), "x" * 400 + "y" * 399, noise(50) + "xy" * 700 + "z" + "yx" * 220, "xy" * 200 + noise(30), noise(90) + line * 40 + noise(10), line * 11, line[5:] + line * 10 + "!" + noise(500), "abcde" * 81, "q" * 405 + noise(20)]
    found = suffix.remove_repeats(docs_of(spark, texts)).collect()
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == repeated_bytes([t.encode() for t in texts], 400)
    data = np.frombuffer(("x" * 200_000).encode(), np.uint8)
    (at, lo, hi), sure = suffix.without_periods(data, suffix.anchors(data))
    assert len(at) <= 2 and sure.tolist() == [[0, 200_000 - 400]]
    for t in (prose(3000), "ab" * 4000, noise(400)):
        data = np.frombuffer(t.encode(), np.uint8)
        for a, b in zip(suffix.anchors(data), suffix.anchors(data, block=500), strict=True):
            assert a.tolist() == b.tolist()
    r = np.random.default_rng(3)
    letters = lambda n: r.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    passage = letters(1000)
    texts = [letters(5_000_000) + "0" + passage + "1" + letters(600_000) + "2" + passage + "3" + letters(10), letters(700) + "4" + passage[100:] + "5", letters(900)]
    found = {r.doc_id: r for r in suffix.remove_repeats(docs_of(spark, texts)).collect()}
    assert [(found[i].n_removed, found[i].n_spans) for i in range(3)] == [(2000, 2), (900, 1), (0, 0)]
    assert bytes(found[0].kept).decode() == texts[0].replace(passage, "") and bytes(found[2].kept).decode() == texts[2]


def passage_words(docs, size=50):
    count, texts = collections.Counter(), [re.findall(rb"[^\x20\x09-\x0d]+", t) for t in docs]
    for w in texts:
        count.update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for w in texts:
        hit = bytearray(len(w))
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                hit[i : i + size] = b"\1" * size
        out.append(sum(hit))
    return out


def test_suffix_dedup_counts_words_of_passages(spark):
    own = random.Random(31)
    word = lambda: "".join(own.choice("abcdefgh\u00e9") for _ in range(own.choice((1, 2, 3, 4, 12))))
    some = lambda n: [word() for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 52, 55, 60, 75, 100, 160)]
    texts = list(ODD)
    for _ in range(70):
        parts = []
        for _ in range(own.randrange(1, 4)):
            p, kind = own.choice(passages), own.random()
            at = own.randrange(len(p))
            parts += p if kind < 0.4 else p[at // 3 :] if kind < 0.6 else [*p[:at], "#", *p[at + 1 :]] if kind < 0.8 else []
            parts += some(own.randrange(0, 70))
        texts.append("".join(x for w in parts for x in (w, own.choice((" ", "\n", "\t \x0b", "  ")))))
    short, long = " ".join("abc"[i % 3] for i in range(50)), [*some(20), "m" * 700, *some(12), "n" * 49, *some(20)]
    texts += [short, short, "a " * 3000, "x " + "a\n" * 70, "one two three four five " * 40 + "six", "is " * 49]
    texts += [" ".join(some(5) + long), "\n".join(long + some(3)), " ".join(long).replace("m" * 700, "m" * 701), texts[12], texts[12].replace(" ", "\n")]
    # Words with the same beginnings and lengths are not taken for each other.
    texts += [" ".join(["beginning" + "abcd"[i % 4] for i in range(120)]), " ".join("beginning" + own.choice("abcd") for _ in range(300))]
    found = suffix.remove_repeats(docs_of(spark, texts)).orderBy("doc_id").collect()
    docs = [(t or "").encode() for t in texts]
    assert [r.n_passage_words for r in found] == passage_words(docs)
    assert collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == repeated_bytes(docs, 400)
    assert sum(r.n_passage_words > 0 and not r.n_removed for r in found) > 20


def test_merge_of_many_parts(spark):
    own = random.Random(2)
    rows = [(own.choice([7, 8, 9]), i, bytes(own.choice(b"ab") for _ in range(12))) for i in range(3000)] + [(1, i, b"a" * 12) for i in range(500)]
    starts = spark.createDataFrame(rows, "rid long, x int, suffix binary").repartition(5)
    count = collections.Counter(r[2] for r in rows)
    for parts in (1, 7, 40):
        found = suffix.sorted_neighbours(starts, 12, parts).collect()
        assert sorted({(r.rid, r.x) for r in found}) == sorted((a, x) for a, x, t in rows if count[t] > 1)


def test_loser_tree_keeps_prefixes():
    for n in (1, 2, 3, 7):
        items = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(200)]
        runs = [suffix.Run(iter([(a, b, ()) for a, b in zip(*suffix.front_coded(sorted(items[i::n])), strict=True)])) for i in range(n)]
        got = list(suffix.merged(runs))
        want = sorted(items)
        assert [g[1] for g in got] == want
        assert all(g[0] == suffix.common(a, b) for g, a, b in zip(got[1:], want, want[1:], strict=False))


def test_sentence_spans(spark):
    shared = "Shared one is here now. Shared two comes right after it. Shared three ends the passage that many hold, with more words. "
    texts = [*ODD, shared + prose(40), prose(30) + ". " + shared + prose(20), "Own text. " * 2, shared.strip(), shared.strip()]
    found = {r.doc_id: r for r in sentences.remove_repeats(docs_of(spark, texts)).collect()}
    first, every = {}, []
    for i, t in enumerate(texts):
        assert b"".join(sentences.sentences((t or "").encode())) == (t or "").encode()
        every += [(i, *x) for x in zip(*sentences.runs((t or "").encode()), strict=True)]
    for i, a, _, h in every:
        first[h] = min(first.get(h, (i, a)), (i, a))
    gone = collections.defaultdict(set)
    for i, a, b, h in every:
        if first[h] != (i, a):
            gone[i] |= set(range(a, b))
    for i, t in enumerate(texts):
        pieces = sentences.sentences((t or "").encode())
        assert found[i].n_sentences == len(pieces) and found[i].n_removed == len(gone[i])
        assert found[i].text == b"".join(p for k, p in enumerate(pieces) if k not in gone[i]).decode()
    k = len(ODD)
    assert found[k].n_removed == 0 and "Shared two" in found[k].text
    assert "Shared two" not in found[k + 1].text and found[k + 4].text == ""
    df, texts, _ = odd_docs(spark)
    assert sentences.remove_repeats(df).count() == len(texts) and sentences.remove_repeats(df.limit(0)).count() == 0


def test_repeated_words_leave_with_their_sentences(spark):
    own = random.Random(8)
    word = lambda: "".join(own.choice("abcdefgh") for _ in range(7))
    said = lambda n: " ".join(word() for _ in range(n)) + ". "
    long, tail = said(70), said(30) + said(25) + said(4) + said(3) + said(5)
    texts = [said(30) + long + said(25) + tail + said(40)]
    texts += [said(22) + long + said(31), said(24) + tail + said(21), said(9) + said(6) + tail + said(2) + said(28), said(6) + said(8) + said(23) + said(26)]
    found = {r.doc_id: r.text for r in sentences.remove_repeats(docs_of(spark, texts)).collect()}
    seen = set()
    for i, t in enumerate(texts):
        words = t.split()
        covered = {j for p in range(len(words) - 49) if tuple(words[p : p + 50]) in seen for j in range(p, p + 50)}
        seen |= {tuple(words[p : p + 50]) for p in range(len(words) - 49)}
        assert found[i].split() == [w for j, w in enumerate(words) if j not in covered]
        assert bool(covered) == (i in (1, 2, 3))


# --- decontamination ----------------------------------------------------------------------------

ITEM = "Yesterday Jon bought 3 apples and 5 pears for 4 dollars at the old market while Jon waited 2 hours near it"
OTHER = ITEM.replace("Jon", "Mira").replace("3 apples", "7 apples").replace("2 hours", "9 minutes")
MIXED = ITEM.replace("Jon waited", "Mira waited")


@pytest.mark.parametrize("held", [decontaminate.HELD_WINDOWS, 0])
def test_decontamination(spark, held):
    bench = spark.createDataFrame([(1, ITEM), (2, "tiny item"), (3, None), (3, ""), (4, "what is the mass of the given stone in total here")], "item_id long, text string")
    texts = [*ODD, prose(30) + " " + ITEM + " " + prose(30), "So it goes. " + OTHER, "So it goes. " + MIXED, "Half of it: " + " ".join(ITEM.split()[:14]), prose(200), "an unrelated text of the old market while someone waited"]
    found = {r.doc_id: r for r in decontaminate.scan(docs_of(spark, texts), bench, held).collect()}
    k = len(ODD)
    assert [found[k + i].items for i in range(6)] == ["1", "1", "", "1", "", ""]
    assert found[k + 2].n_hits > 0  # its windows match, its slots do not
    assert not any(found[i].contaminated for i in range(k))
    df = docs_of(spark, texts)
    kept = decontaminate.remove(df, bench, held)
    assert kept.columns == df.columns and kept.count() == len(texts) - 3
    assert decontaminate.scan(df, bench.limit(0), held).filter("contaminated").count() == 0
    assert decontaminate.scan(df.limit(0), bench, held).count() == 0
    df, texts, _ = odd_docs(spark)
    assert decontaminate.scan(df, bench, held).count() == len(texts)


def brute_leaks(texts, items):
    """(n_hits, item ids) of each text, from every pair of places."""
    kinds = decontaminate._Kinds()
    strip = lambda w: w.strip(decontaminate._STRIP).lower()

    def made(t):
        words, h = decontaminate.template(t.encode(), kinds)
        return words, h.tolist(), [x in set(decontaminate.SLOTS.tolist()) for x in h.tolist()]

    def key(words, h, slot, i, n):
        return tuple(strip(w) for w in words[i : i + n]) if all(slot[i : i + n]) else tuple(h[i : i + n])

    own = [(i, made(t or "")) for i, t in items if i is not None]
    out = []
    for t in texts:
        words, h, slot = made(t or "")
        hits, leaks = set(), set()
        for i, (iw, ih, islot) in own:
            n = min(8, len(iw))
            at = {(d, p) for p in range(len(iw) - n + 1 if n else 0) for d in range(len(words) - n + 1) if key(words, h, slot, d, n) == key(iw, ih, islot, p, n)}
            hits |= {(d, n) for d, _ in at}
            for d, p in at:
                if (d - 1, p - 1) in at:
                    continue
                k = 1
                while (d + k, p + k) in at:
                    k += 1
                k += n - 1
                pairs = [(ih[p + j], strip(iw[p + j]), strip(words[d + j])) for j in range(k) if islot[p + j]]
                same = all((a == x) <= (b == y) for _, a, b in pairs for _, x, y in pairs)
                names = [q for q in pairs if q[0] == decontaminate.NAME_SLOT]
                if k >= min(13, 0.5 * len(iw)) and same and all((b == y) <= (a == x) for _, a, b in names for _, x, y in names):
                    leaks.add(i)
        out.append((len(hits), ",".join(map(str, sorted(leaks)))))
    return out


@pytest.mark.parametrize("held", [decontaminate.HELD_WINDOWS, 0])
def test_decontamination_against_brute_force(spark, held):
    own = random.Random(9)
    vocabulary = "the a of Jon Mira Ada 3 5 70 kg miles box sells and then near old".split()
    said = lambda n: " ".join(own.choice(vocabulary) for _ in range(n))
    bodies = [said(n) for n in (3, 5, 9, 14, 20, 30, 60)]
    items = [*enumerate(bodies), (2, said(12)), (2, bodies[4]), (3, bodies[3]), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (10, "0 " * 40), (11, "word " * 30), (None, bodies[5]), (12, None)]
    swap = lambda t: " ".join(m.get(w, w) for m in [{"Jon": own.choice(["Jon", "Ada", "Eve"]), "3": own.choice(["3", "8", "5"]), "kg": "miles"}] for w in t.split())
    texts = [None, "", "0 " * 300, "word " * 300, "9 " * 50, "11 12 13 14 15 16 17 18 19", said(200)]
    for body in bodies * 4:
        w = swap(body).split()
        a = own.randrange(len(w))
        texts.append(" ".join([said(own.randrange(20)), *w[a // 2 : len(w) - own.randrange(3)], said(own.randrange(20))]))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: (r.n_hits, r.items) for r in decontaminate.scan(docs_of(spark, texts), bench, held).collect()}
    want = dict(enumerate(brute_leaks(texts, items)))
    assert found == want and sum(bool(x[1]) for x in want.values()) > 5
    clash = docs_of(spark, texts).selectExpr("*", "1 as n_hits", "2 as items", "3 as hits", "4 as text_")
    assert sorted(r.doc_id for r in decontaminate.remove(clash, bench, held).collect()) == [i for i, x in want.items() if not x[1]]


@pytest.mark.parametrize("held", [decontaminate.HELD_WINDOWS, 0])
def test_short_items_inside_long_documents(spark, held):
    items = [(1, "blue tiny thing"), (2, "seven odd old words make this item"), (3, "lone"), (4, "blue tiny thing"), (5, ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [prose(40) + " a blue tiny thing " + prose(30), prose(20) + " seven odd old words make this item " + prose(20) + " blue tiny thing", "lone", "blue tiny", "We met. " + ITEM + " and one lone blue tiny thing", prose(60)]
    found = {r.doc_id: (r.n_hits, r.items) for r in decontaminate.scan(docs_of(spark, texts), bench, held).collect()}
    n = len(ITEM.split()) - 8 + 1
    assert found == {0: (1, "1,4"), 1: (2, "1,2,4"), 2: (1, "3"), 3: (0, ""), 4: (n + 2, "1,3,4,5"), 5: (0, "")}


# --- rules and classifiers ----------------------------------------------------------------------


def rule_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_rules(spark):
    texts = [*ODD, prose(60), "same words again " * 30, "a b c d\n" * 40, "#" * 50 + " x", *[prose(90) for _ in range(60)], "$%& " * 200 + prose(60)]
    found = {r.doc_id: r for r in rules.judge(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        n = rule_counts(t or "")
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n, t
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r.base_failed and r.kept)
    assert all(found[len(ODD) + 4 + i].kept for i in range(60))
    df = docs_of(spark, texts)
    kept = rules.apply(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in found.items() if r.kept)
    df, texts, _ = odd_docs(spark)
    assert rules.judge(df).count() == len(texts) and rules.judge(df.limit(0)).count() == 0


def test_bands_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(r.doc_id, r.text or "", r.lang) for r in rows]
    order, size = rules.ORDER, rules.SYMBOLS
    coded = {i: [int(c) for c in rules._TABLE[np.minimum([ord(c) for c in "\n" * (order - 1) + t], len(rules._TABLE) - 1)]] for i, t, _ in rows}
    full = collections.Counter(tuple(c[k : k + order]) for c in coded.values() for k in range(len(c) - order + 1))
    levels = [full]
    for _ in range(order - 1):
        levels.insert(0, collections.Counter(g[1:] for g in levels[0]))
    cuts, sums, held = [], [], []
    for counts in levels:
        n = collections.Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] and n[3] else None
        d = [0, 0.5, 1.0, 1.5] if y is None else [0, *(min(max(k - (k + 1) * y * ((n[k + 1] or n[k]) if k == 3 else n[k + 1]) / n[k], lo), hi) for k, lo, hi in ((1, 0.05, 0.95), (2, 0.1, 1.9), (3, 0.15, 2.9)))]
        total, back = collections.Counter(), collections.Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            back[g[:-1]] += d[min(c, 3)]
        cuts.append(d)
        sums.append(total)
        held.append(back)

    def p(g):
        k = len(g) - 1
        lower = p(g[1:]) if k else 1 / size
        total, c = sums[k][g[:-1]], levels[k][g]
        return lower if not total else (c - cuts[k][min(c, 3)]) / total + held[k][g[:-1]] / total * lower

    log = {g: -np.log(p(g)) for g in full}
    lp = {i: np.mean([log[tuple(c[k : k + order])] for k in range(len(c) - order + 1)]) for i, c in coded.items() if len(c) >= order}
    count = {i: rule_counts(t) for i, t, _ in rows}
    passed = {i for i, n in count.items() if n[0] >= 50 and 100 * n[4] <= 50 * n[0]}
    kept = set()
    for lang in {r[2] for r in rows}:
        own = sorted(lp[i] for i, _, x in rows if x == lang and i in passed)
        if own:
            lo, mid, hi = (own[max(0, -(-len(own) * q // 4) - 1)] for q in (1, 2, 3))
            kept |= {i for i, _, x in rows if x == lang and i in passed and abs(lp[i] - mid) <= max(hi - lo, rules.FLOOR) * (rules.WIDTH + rules.SPREAD / count[i][0] ** 0.5)}
    found = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert all(abs(found[i].log_perplexity - x) < 1e-4 for i, x in lp.items())
    assert {i for i, r in found.items() if r.kept} == kept
    truth = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = passed - kept
    assert sum(truth.get(i) == 0 for i in out) >= 5 and sum(truth.get(i) == 1 for i in out) <= 1


def test_bands_of_many_documents_are_exact(spark):
    x = F.round(F.abs(F.xxhash64("id")) / 2.0**62, 6)
    lang = F.when(F.col("id") % 3 == 0, "en").when(F.col("id") % 3 == 1, "de")
    rows = spark.range(0, 400_000, 1, 9).select(lang.alias("lang"), F.lit(60).alias("n_words"), F.lit(0).alias("n_repeat_words"), x.alias("log_perplexity"))
    rows = rows.unionByName(rows.filter("lang = 'de'").limit(3).withColumn("lang", F.lit("one"))).cache()
    rows = rows.unionByName(rows.withColumn("n_words", F.lit(49)).withColumn("log_perplexity", F.lit(9.0)))
    own = collections.defaultdict(list)
    for r in rows.filter("n_words >= 50").collect():
        own[r.lang].append(r.log_perplexity)
    want = {}
    for k, v in own.items():
        lo, mid, hi = (sorted(v)[-(-len(v) * i // 4) - 1] for i in (1, 2, 3))
        want[k] = (mid, max(hi - lo, rules.FLOOR))
    assert {r[0]: (r.middle, r.unit) for r in rules.bands(rows).collect()} == want and len(want) == 4
    assert rules.bands(rows.limit(0)).count() == 0


def test_kneser_ney_is_a_distribution(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = rules.fit(d)
    p = np.exp(model.log_table().astype(float)).reshape(-1, rules.SYMBOLS)
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    counts = collections.Counter()
    for r in d.select("text").collect():
        counts.update(rules.grams(r.text or "").tolist() if r.text else [])
    assert dict(zip(model.keys[-1].tolist(), model.counts[-1].astype(int).tolist(), strict=True)) == dict(counts)


def other_scripts(n, more=()):
    """Texts of words of other scripts, and the first of them with its characters in any order."""
    own = random.Random(8)
    words = ["".join(own.choice("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏") for _ in range(own.randrange(2, 5))) for _ in range(40)]
    texts = [" ".join(own.choice([*words, *more]) for _ in range(150)) for _ in range(n)]
    mixed = list(texts[0].replace(" ", ""))
    own.shuffle(mixed)
    return [*texts, "".join(" " if c == " " else mixed.pop() for c in texts[0])]


def test_other_scripts_are_judged_by_their_characters(spark):
    import corpus_pipeline as p

    texts = other_scripts(60)
    df = docs_of(spark, texts)
    found = {r.doc_id: r for r in rules.judge(df).collect()}
    assert not any(r.base_failed for r in found.values())
    assert sum(found[i].kept for i in range(60)) >= 58 and not found[60].kept
    assert {r.doc_id for r in p.quality_rules(spark, df, SF).collect()} == {i for i, r in found.items() if r.kept}


def test_other_scripts_against_brute_force(spark):
    texts = [*other_scripts(12, ["привет", "мир", "ελληνικά", "👍", "Word"]), *ODD, prose(80), "日" * 300]
    order = rules.ORDER
    kind = lambda c: int(rules._TABLE[ord(c)]) if ord(c) < len(rules._TABLE) and rules._TABLE[ord(c)] < rules.SYMBOLS else c
    coded = [[kind(c) for c in "\n" * (order - 1) + (t or "")] for t in texts]
    levels = [collections.Counter(tuple(c[k : k + order]) for c in coded for k in range(len(c) - order + 1))]
    for _ in range(order - 1):
        levels.insert(0, collections.Counter(g[1:] for g in levels[0]))
    size = rules.SYMBOLS + len({s for c in coded for s in c if isinstance(s, str)})
    cuts = []
    for counts in levels:
        n = collections.Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2])
        cuts.append([0, *(min(max(k - (k + 1) * y * ((n[k + 1] or n[k]) if k == 3 else n[k + 1]) / n[k], lo), hi) for k, lo, hi in ((1, 0.05, 0.95), (2, 0.1, 1.9), (3, 0.15, 2.9)))])

    total, back = [collections.Counter() for _ in levels], [collections.Counter() for _ in levels]
    for k, counts in enumerate(levels):
        for g, c in counts.items():
            total[k][g[:-1]] += c
            back[k][g[:-1]] += cuts[k][min(c, 3)]

    def share(g):
        k = len(g) - 1
        lower = share(g[1:]) if k else 1 / size
        return (levels[k][g] - cuts[k][min(levels[k][g], 3)]) / total[k][g[:-1]] + back[k][g[:-1]] / total[k][g[:-1]] * lower

    lp = {i: -np.mean([np.log(share(tuple(c[k : k + order]))) for k in range(len(c) - order + 1)]) for i, c in enumerate(coded) if len(c) >= order}
    for ids in (None, [i // 2 for i in range(len(texts))]):  # unique ids, and repeated ones
        df = docs_of(spark, texts, ids).select("doc_id", "text", "lang")
        for held in (10**6, 0):  # both paths
            model = rules.fit(df, held)
            assert (model.far is None) == bool(held)
            rows = rules.measured(df, model).collect()
            wanted = sorted((i if ids is None else ids[i], rule_counts(t or "")[1], round(lp.get(i, -1), 5)) for i, t in enumerate(texts))
            got = sorted((r.doc_id, r.word_chars, -1 if r.log_perplexity is None else r.log_perplexity) for r in rows)
            assert [g[:2] for g in got] == [w[:2] for w in wanted] and np.allclose([g[2] for g in got], [w[2] for w in wanted], atol=1e-5)


def test_classifiers(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r for r in labels.collect()}
    for module, label, least, parts, part in ((quality, "quality", 0.95, 4, 2), (toxicity, "toxic", 0.93, 5, 0)):
        found = module.classify(d, labels).collect()
        assert len(found) == d.count() and all(0 <= r.score <= 1 for r in found)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in found)
        held = [r for r in found if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id][label] for r in held) / len(held) >= least
        flipped = labels.withColumn(label, labels[label] if False else 1 - labels[label]).filter(f"crc32(cast(doc_id as string)) % {parts} = {part}")
        again = module.classify(d, labels.filter(f"crc32(cast(doc_id as string)) % {parts} <> {part}").unionByName(flipped)).collect()
        assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in found}  # held-out labels change nothing
        df, texts, _ = odd_docs(spark)
        assert module.classify(df, labels).count() == len(texts)
        assert module.classify(df, labels.limit(0)).count() == len(texts) and module.classify(df.limit(0), labels).count() == 0


def test_training_sample_is_bounded(spark):
    from pyspark.sql import functions as F

    from sqlloom.llm import linear

    rows = [(1, f"copy {i % 3}") for i in range(4000)] + [(i, "long " * 300) for i in range(2, 40)] + [(50, None), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    chosen = linear.labelled(df, labels, "quality", F.lit(True)).collect()
    assert sorted(r.id for r in chosen) == [*range(1, 40), 50]
    assert len(linear.labelled(df, labels, "quality", F.lit(True), 10).collect()) <= 10
    known = labels.selectExpr("doc_id as id", "quality as y").filter("id is not null").distinct()
    assert sum(len(r.text) for r in linear.training_texts(df, known, 100, 10_000).collect()) <= 10_000
    assert {r.text for r in chosen if r.id == 1} <= {f"copy {i}" for i in range(3)}
    w = [b"a" * 23 + b"B" * 4 + b"c" * 7 + b"1", b"Ab9." * 30]
    assert len({quality._Words()[x] >> 32 for x in (w[1], w[1] + b"Z")}) == 2


def test_toxicity_labels_by_em(spark):
    texts = ["you met him and then. " * 3 + "well, you utter idiot", "you said it. the idiot", "@#$%! now", None]
    rows = toxicity.voted(docs_of(spark, texts).selectExpr("doc_id as id", "text", "1 as y")).sort("id").collect()
    assert [list(r.patterns) for r in rows] == [[p.search((t or "").encode()) is not None for p in toxicity.PATTERNS] for t in texts]
    # Hidden labels are inferred from votes that fall together.
    r = np.random.default_rng(4)
    y = (r.random(3000) < 0.2).astype(float)
    v = (r.random((3000, 6)) < np.where(y[:, None] > 0.5, 0.5, 0.02)).astype(np.int8)
    model = toxicity.LabelModel().fit(v, np.full(3000, np.nan))
    p, n = model.posterior(v), v.sum(1)
    assert (p[n > 2] > 0.9).all() and (p[n == 0] < 0.5).all() and p[y > 0.5].mean() > 3 * p[y < 0.5].mean()
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    _, known, _, _, _ = toxicity.training(d, labels, toxicity.SAMPLE)
    assert np.isnan(known).sum() > 100 and (~np.isnan(known)).sum() > 100
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    found = toxicity.classify(d, labels.limit(0)).collect()
    assert 0 < sum(r.predicted for r in found) < len(found) / 4
    told = [truth[r.doc_id] for r in found if r.predicted and r.doc_id in truth]
    assert sum(told) >= 0.8 * len(told) > 0


def test_every_document_votes(spark):
    own = random.Random(5)
    words = "you utter idiot moron stupid scum kill trash foobarish foobared nice day sun walk".split()
    texts = [" ".join(own.choice(words[8:] if own.random() < 0.7 else words) for _ in range(6)) for _ in range(400)] + [None, "", "$#@! x"]
    docs = docs_of(spark, texts)
    train = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 0]
    seeds = train[:40]
    y = np.array([float("idiot" in texts[i] or "scum" in texts[i]) for i in seeds])
    induced = [b"foobar", b"nice$"]
    said = lambda ids: toxicity.votes([(texts[i] or "").encode().lower() for i in ids], [[p.search((texts[i] or "").encode()) is not None for p in toxicity.PATTERNS] for i in ids], induced)
    rest = [i for i in train if i not in seeds]
    counts = toxicity.vote_counts(docs, induced, set(seeds))
    v = said(rest)
    assert {tuple(toxicity.unpacked(np.array([r.votes]), v.shape[1])[0]): r.n for r in counts.collect()} == dict(collections.Counter(map(tuple, v)))
    a = toxicity.LabelModel().fit(said(seeds), y, others=toxicity.summed_votes(counts, v.shape[1]))
    b = toxicity.LabelModel().fit(np.concatenate([said(seeds), v]), np.concatenate([y, np.full(len(rest), np.nan)]))
    alone = toxicity.LabelModel().fit(said(seeds), y)
    assert np.allclose(a.yes1, b.yes1) and np.allclose(a.weight, b.weight) and np.allclose(a.posterior(v), b.posterior(v))
    assert np.abs(a.yes1 - alone.yes1).max() > 0.01  # documents without labels move the rates


def test_ftrl_learns_and_stays_sparse():
    from sqlloom.llm.linear import Ftrl

    r = np.random.default_rng(1)
    rows = []
    for _ in range(600):
        y = float(r.random() < 0.5)
        at = np.unique(np.r_[r.integers(10, 500, 20), 3 if y else 4])
        rows.append((at, np.ones(len(at)), y))
    w = Ftrl(size=512, l1=2.0).fit(rows)
    assert w[3] > 0.5 > -0.5 > w[4] and (w[10:500] != 0).mean() < 0.5


# --- chat ---------------------------------------------------------------------------------------


def test_chat(spark):
    said = [r"\### Assistant: </turn> ok", None, "", "### user: x</turn>\n### assistant: y", "\\", "a\\\\b", "plain " * 400, "</turn>", "é" * 30]
    rows = []
    for c in range(30):
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t or c % 2 else "system", rng.choice(said) if rng.random() < 0.5 else prose(rng.randrange(1, 120))))
    rows += [(None, 0, None, "x"), (-7, 0, "user", said[0]), (-7, 1, "assistant", said[0]), (50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (51, 0, "a:b\\ c", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    w = chat.format_windows(df, budget=200)
    assert all(r.tokens <= 200 or r.n_turns == 1 for r in w.collect())
    want = {}
    for c in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c))
        loss = "".join(t for _, role, t in own if role == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for found in (chat.digest(w), chat.digest(chat.format_windows(df))):
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found.collect()} == want
    system = [r for r in w.collect() if r.conv_id == 0 and r.window > 0]
    assert all(chat.read_turns(r.text)[0][0] == "system" for r in system if r.n_repeated)
    assert chat.format_windows(df.limit(0)).count() == 0


def test_only_a_turn_longer_than_the_budget_exceeds_it():
    size = lambda t: len(t.split())
    for system, budget in ((150, 200), (195, 200), (260, 200)):
        turns = [("system", "s " * system)] + [("user" if k % 2 else "assistant", "t " * n) for k, n in enumerate((30, 60, 90, 120, 20, 250, 40, 70, 199, 5))]
        found = list(chat.windows(iter(turns), size, budget))
        assert sum(w["n_turns"] for w in found) == len(turns)
        assert [(r, t) for w in found for r, t in chat.read_turns(w["text"])[w["n_repeated"] :]] == turns
        for w in found:
            alone = w["n_turns"] == 1 and w["n_repeated"] == 0 and size(chat.write_turn(*turns[w["first_turn"]])[0]) > budget
            assert w["tokens"] <= budget or alone, (system, w)


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p

    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "simhash_near_dedup", "template_decontamination", "secret_scan", "best_fit_packing"]
    good = {r.doc_id for r in rules.judge(d).filter("kept").collect()}
    rest = d.filter(d.doc_id.isin(sorted(good)))
    least = {r.component_id for r in simhash.cluster(rest).collect()}
    rest = rest.filter(rest.doc_id.isin(sorted(least)))
    clean = {r.doc_id for r in decontaminate.scan(rest, bench).filter("not contaminated").collect()}
    texts = {r.doc_id: r.text for r in rest.collect() if r.doc_id in clean}
    spans = {r.doc_id: r.spans for r in secrets.scan(rest.filter(rest.doc_id.isin(sorted(clean)))).collect()}
    for i, found in spans.items():
        out, at = [], 0
        for s in found:
            if s.start >= at:
                out += [texts[i][at : s.start], f"<{secrets.KINDS[s.kind]}>"]
            at = max(at, s.end)
        texts[i] = "".join([*out, texts[i][at:]])
    import public_tokenizers
    from tokenizers import Tokenizer

    check_packed(p.run(spark, "/root/testdata/sf0.01").collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), list(texts.items()), 2048)


def test_pipeline_of_other_scripts(spark, tmp_path):
    import corpus_pipeline as p

    texts = other_scripts(40)
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in p.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert len(kept) >= 38 and 40 not in kept


def test_stages_with_odd_input(spark):
    import corpus_pipeline as p

    df, texts, _ = odd_docs(spark)
    bench = "/root/testdata/sf0.001"
    kept = [n for n, t in enumerate(texts) if len((t or "").split()) >= 50]
    for name, stage in p.STAGES[:-1]:
        clash = df.selectExpr("*", "1 as n_hits", "2 as items", "3 as n_words", "4 as spans", "5 as marks", "6 as kept", "7 as lang_", "8 as key")
        found = stage(spark, clash, bench)
        assert found.columns == clash.columns and found.count() <= len(texts)
        assert stage(spark, clash.limit(0), bench).count() == 0
        if name in ("template_decontamination", "secret_scan"):
            assert found.count() == len(texts)
    assert 0 < p.quality_rules(spark, df, bench).count() <= len(kept)
    packed = p.best_fit_packing(spark, df, bench)
    assert packed.select("doc_id").filter("doc_id is null").count() >= 2 and p.best_fit_packing(spark, df.limit(0), bench).count() == 0
    before = common.made()
    out = p.run(spark, bench)
    assert common.made() == before + 1 and out.count() > 0


def test_very_long_texts_in_every_operator(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = random.Random(21)
    long = " ".join(f"w{own.randrange(3000)}" + own.choice(["", "", ".", "\n"]) for _ in range(250_000)) + " é日 " + "z" * 50_000
    texts = [long, long[:4000], "x", None]
    df = docs_of(spark, texts).drop("rid", "row")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packed(packing.pack(df).collect(), tok, list(enumerate(texts)), 2048)
    found = {r.doc_id: r for r in rules.judge(df).collect()}
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in (found[i] for i in range(4))] == [rule_counts(t or "") for t in texts]
    assert {r.doc_id: r.spans for r in secrets.digest(df).collect()} == {i: "" for i in range(4)}
    prints = {r.doc_id: r.fingerprint for r in simhash.cluster(df).collect()}
    assert [int(prints[i], 16) for i in range(4)] == [simhash.fingerprint((t or "").encode()) for t in texts]
    cut = {r.doc_id: r for r in sentences.remove_repeats(df).collect()}
    assert cut[0].text == long and len(cut[1].text) < 100
    bench = spark.createDataFrame([(1, " ".join(long.split()[200_000:200_030])), (2, "never said " * 9)], "item_id long, text string")
    assert [decontaminate.scan(df, bench, held).filter("items = '1'").select("doc_id").collect()[0].doc_id for held in (0, 10**6)] == [0, 0]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(df, labels).count() == toxicity.classify(df, labels).count() == 4
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "assistant", "end")], "conv_id long, turn long, role string, text string")
    said = chat.digest(chat.format_windows(turns)).collect()[0]
    assert (said.n_turns, said.loss_chars, said.n_over) == (3, len(long) + 3, 2)
    assert said.loss_sha256 == hashlib.sha256((long + "end").encode()).hexdigest()
