"""Operators' inner parts against brute force and against the public libraries."""

import itertools
import random
import re

import numpy as np
import public_tokenizers as files
import pytest
import sentencepiece
from tokenizers import Tokenizer

from junctura.llm import automaton, bpe, decontam, dedup, langid, mjpeg, pieces, secret_scan, token_counts, words
from junctura.llm.bpe import coder
from junctura.llm.token_store import tokenizer
from junctura.llm.wavelet import WaveletMatrix

MODEL = files.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", " a", " the", "'s", "'ll", "é", "🙂", "▁", "1", "2024", "ing", "-", "--", "日本", "x", "<s>", "<0x41>", "</s>", "\x00", "\x1c", " \n", "\xa0", "word", "<|endoftext|>", "́", "　"]


def texts(n, most, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_pieces_equal_the_library():
    ours, lib = pieces.piece_model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    for t in ["", " ", "a", "ab" * 5000, *texts(4000, 14)]:
        ids = ours.encode(t)
        assert ids == lib.encode(t), t
        assert ours.decode(ids) == lib.decode(ids), t
    for _ in range(4000):
        ids = [rng.randrange(3, 260 if rng.random() < 0.5 else 32000) for _ in range(rng.randrange(12))]
        assert ours.decode(ids) == lib.decode(ids), ids


def test_pieces_compatibility_is_remerging():
    ours = pieces.piece_model(MODEL)
    rng = random.Random(2)
    whole = [i for p, i in ours.ids.items() if ours.made[i] or len(p) == 1]
    for _ in range(3000):
        a, b = rng.choice(whole), rng.choice(whole)
        assert ours.remerge(a, b) == (ours.merge(ours.pieces[a] + ours.pieces[b])[0] == [a, b])


def test_byte_ids_equal_the_library():
    ours, lib = coder(*tokenizer()), Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    for t in texts(4000, 16, 3):
        assert ours.ids(t) == lib.encode(t, add_special_tokens=False).ids, t


def test_packed_ids_equal_the_unchanged_library():
    ours, lib = coder(*tokenizer()), Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    for t in ["a <|endoftext|> b", "<|endoftext|>", "日本<|endoftext|>x <|endoftext|", *texts(4000, 16, 8)]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ours.packed(t), "<u2").tolist() == ids, t
        assert ours.library_ids(t) == ids, t
    assert ours.library_ids("a <|endoftext|> b") == [64, 220, 50256, 275]


@pytest.mark.parametrize("block, call, memo", [(8 << 20, 256 << 10, 600_000), (200, 40, 60), (1, 1, 0)])
def test_ids_of_many_texts_equal_the_unchanged_library(monkeypatch, block, call, memo):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
    monkeypatch.setattr(bpe, "CALL_BYTES", call)
    monkeypatch.setattr(bpe, "MEMO_PIECES", memo)
    ours, lib = bpe.Coder(*tokenizer()), Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    blanks = [" ", "\n", "\r\n", "\t", "\x1c", "\x85", "\xa0", "\u1680", "\u180e", "\u200b", "\u2003", "\u2028", "\u3000", "\ufeff"]
    odd = ["".join(rng.choice([" ", rng.choice(blanks), rng.choice(PARTS)]) for _ in range(rng.randrange(12))) for _ in range(1500)]
    many = ["", " ", "  ", " a", "a ", "a  ", "a <|endoftext|> b", "x\n", "x \n", "x" * 3000, *texts(500, 30, 6), *odd, *odd[:50]]
    want = [lib.encode(t, add_special_tokens=False).ids for t in many]
    for _ in range(2):  # the second time from what is remembered
        ids, sizes = ours.encode(many)
        ends = np.cumsum(sizes)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    ids, sizes = ours.encode([])
    assert len(ids) == len(sizes) == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 50257, 3000).astype(np.uint16)
    t[:700] = 7
    w = WaveletMatrix.load(WaveletMatrix.build(t, np.arange(2), np.array([0, 9, 3000])).dump())
    assert (w.tokens() == t).all() and w.starts.tolist() == [0, 9, 3000]
    assert all(w.access(int(i)) == t[i] for i in rng.integers(0, 3000, 100))
    for token in (7, int(t[900]), 3):
        places = np.flatnonzero(t == token)
        assert w.rank(token, 3000) == len(places) and w.rank(token, 500) == (places < 500).sum()
        assert [w.select(token, k) for k in range(len(places))] == places.tolist()
        assert w.select(token, len(places)) == -1
    assert len(WaveletMatrix.load(WaveletMatrix.build(t[:0], t[:0], np.zeros(1)).dump()).tokens()) == 0


def test_token_counts_after_edits():
    c, lib = token_counts.counter(tokenizer()), coder(*tokenizer())
    rng = random.Random(5)
    for t in texts(1200, 25, 6):
        tree = token_counts.PretokenTree.of(t, c)
        assert tree.total() == len(lib.ids(t))
        for new in texts(3, 4, t):
            s = rng.randrange(len(t) + 2)
            e = s + rng.randrange(6)
            s2 = min(s, len(t))
            want = t[:s2] + new + t[max(s2, min(e, len(t))) :]
            t, _ = tree.edit(t, s, e, new, c)
            assert t == want and tree.total() == len(lib.ids(t)) and tree.chars[1] == len(t)


def brute_secrets(t):
    rules = {"assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}
    return sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(rules.values()) for m in re.finditer(p, t, re.A) if len(m[g]) >= n)


def test_secrets_equal_regexes():
    scan = secret_scan.scanner()
    rng = random.Random(2)
    parts = ["token", "secret", "api_key", "APIKEY", "pass", "word", "passwd", "=", ":", " ", "'", '"', "a", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "ſ", "K", "é", "🙂", "-", "\n", "tokentoken", "ghp_" + "x" * 36]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        assert [(a, k, c) for a, k, _, c in secret_scan.spans(t, scan) if k < 3] == brute_secrets(t), t
    key = "-----BEGIN RSA PRIVATE KEY-----"
    assert [k for _, k, _, _ in secret_scan.spans(f"é {key} xoxb-1234567890ab", scan)] == [5, 4]
    assert secret_scan.redact('é token = "abcdef123" ok', scan) == 'é token = "[SECRET]" ok'
    assert secret_scan.redact(None, scan) is None and secret_scan.redact("", scan) == ""


def test_private_keys_go_as_a_whole():
    scan = secret_scan.scanner()
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    body = [*("MIIEpAIBAAKCAQEA+/" + c * 46 for c in "Abc"), "q0/Zg=="]
    headed = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00FF", "", *body]
    for inner in ("\n".join(body), "\r\n".join(body), "\n".join(headed), "\\n".join(body), "\n    ".join(body), "\n# ".join(body)):
        sep = "\\n" if "\\n" in inner else "\n"
        assert secret_scan.redact(f"é {begin}{sep}{inner}{sep}{end} after\nit", scan) == "é [SECRET] after\nit", inner
        assert secret_scan.redact(f"é {begin}{sep}{inner}\n\nHello there, end.", scan) == "é [SECRET]\n\nHello there, end.", inner
        assert secret_scan.redact(f"{begin}{sep}{inner}", scan) == "[SECRET]", inner
    assert secret_scan.redact(f"{begin} {' '.join(body)} {end}{begin}\n{body[0]}\n{end}", scan) == "[SECRET][SECRET]"
    assert secret_scan.redact(f"{begin}\nHello there, no key.", scan) == "[SECRET]\nHello there, no key."


def test_automaton_is_minimal_and_right():
    rules = ["a(b|c){1,2}d?", "(?i:x)[^a-y]+", "ab?"]
    flat = automaton.compile_rules(rules, anywhere=False).flat()
    for n in range(6):
        for s in itertools.islice(itertools.product("abcdxXz", repeat=n), 4000):
            data = "".join(s)
            state = flat[3]
            for c in data.encode().translate(flat[0]):
                state = flat[1][state + c]
            assert flat[2][state] == sum(1 << k for k, r in enumerate(rules) if re.fullmatch(r, data)), data
    assert len(automaton.compile_rules(["(a|b)*abb"], anywhere=False).table) == 5


def test_shingles_and_minmax():
    a = words.shingle_sets([b"a b c d e f", b"A  B\nC D E F", b"a b", b"", b" \t", b"a b c d e a b c d e"])
    assert [len(x) for x in a] == [2, 2, 1, 0, 0, 5]
    assert (a[0] == a[1]).all()
    rng = random.Random(4)
    base = [str(rng.random()) for _ in range(300)]
    hits = 0
    for _ in range(60):
        other = list(base)
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(300)] = str(rng.random())
        s = words.shingle_sets([" ".join(base).encode(), " ".join(other).encode()])
        x, y = dedup.minmax_bands(s)
        hits += bool((x == y).any())
    assert hits == 60


def test_decontamination_recall_at_the_limit():
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "in"] * 60
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(12, 50)))) for i in range(100)]
    index = decontam.build_index(items)
    held, clean = [], []
    for i, t in items * 4:
        w = t.split()
        for _ in range(int(0.2 * len(w))):
            p = rng.randrange(len(w))
            w[p : p + 1] = [[rng.choice(vocab)], [], [w[p], rng.choice(vocab)]][rng.randrange(3)] or []
        pad = [rng.choice(vocab) for _ in range(rng.randrange(80))]
        held.append((i, " ".join([*pad, *w, *pad]).encode()))
        clean.append(" ".join(rng.choice(vocab) for _ in range(120)).encode())
    found = decontam.find_items(index, [x for _, x in held])
    assert sum(i in {index.ids[k] for k, _, _ in f} for (i, _), f in zip(held, found, strict=True)) >= 0.97 * len(held)
    assert not any(decontam.find_items(index, clean))
    assert decontam.find_items(decontam.build_index([(1, "a b C."), (2, ""), (3, None)]), [b"x A, b c!", b"", b"a c b"]) == [[(0, 0, 1)], [], []]


def edited(w, edits, rng, vocab):
    w = list(w)
    for p in rng.sample(range(len(w)), edits):
        w[p] = rng.choice([rng.choice(vocab), "", f"{w[p]} {rng.choice(vocab)}"])
    return " ".join(w)


def test_decontamination_recall_by_item_length():
    """Items below LONG words without loss, wherever their edits are and whatever the other items are; longer ones nearly so."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(2000)] + ["the", "of", "in"] * 200
    lengths = [1, 2, 4, 5, 6, 8, 9, 10, 11, 12, 14, 15, 16, 19, 20, 24, 30, 50]
    items = [(n * 100 + i, [rng.choice(vocab) for _ in range(n)]) for n in lengths for i in range(40)]
    index = decontam.build_index([(i, " ".join(w)) for i, w in items])
    held = []
    for i, w in items:
        k = int(0.2 * len(w))
        pad = [rng.choice(vocab) for _ in range(rng.randrange(30))]
        held += [(i, " ".join([*pad, edited(w, k, rng, vocab), *pad]).encode()) for _ in range(5)]
        if k:
            held.append((i, " ".join([*pad, "other", *w[1:], *pad]).encode()))
    hit, all_ = dict.fromkeys(lengths, 0), dict.fromkeys(lengths, 0)
    for (i, _), f in zip(held, decontam.find_items(index, [x for _, x in held]), strict=True):
        all_[i // 100] += 1
        hit[i // 100] += i in {index.ids[k] for k, _, _ in f}
    recall = {n: hit[n] / all_[n] for n in lengths}
    print(recall)
    assert all(recall[n] == 1 for n in lengths if n < decontam.LONG), recall
    assert all(r >= 0.95 for r in recall.values()), recall


def test_edit_distance():
    rng = random.Random(9)

    def slow(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item, 1):
            new = [i]
            for j, y in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.randrange(1, 9))]
        text = [rng.randrange(4) for _ in range(rng.randrange(12))]
        assert decontam.edit_distance_within(item, text) == slow(item, text)


def test_forward_sums_all_segmentations():
    table = langid.lattice(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    names = [lib.id_to_piece(i) for i in range(3 + 256, lib.vocab_size())]
    number = {p: i for i, p in enumerate(names, 1)}
    rng = np.random.default_rng(0)
    p = rng.random((table.size, 2))
    p[0], p[-1] = 0, langid.UNKNOWN

    def slow(w):
        total = np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(w) - 1):
            parts, at = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(w[at:i])
                    at = i
            parts.append(w[at:])
            value = np.ones(2)
            for s in parts:
                value = value * (p[number[s]] if s in number else langid.UNKNOWN if len(s) == 1 else 0)
            total += value
        return np.log(total)

    for w in ("hello", "ÿ日x", "the", "🙂ab", "ation"):
        assert np.allclose(langid.log_scores([w], table, p)[0], slow("▁" + w))
    q = p[:, 0]
    c = langid.expected_counts(["hello"], np.ones(1), table, q)
    lengths = np.array([0, *map(len, names), 1])
    assert abs((c * lengths).sum() - len("▁hello")) < 1e-6


def test_frames_are_lossless():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (50, 24, 24)).astype(np.uint8)
    x[5], x[6], x[7, ::2] = 255, 0, 255
    coded = [mjpeg.frame_head() + e + mjpeg.EOI for e in mjpeg.encode_frames(x)]
    assert (mjpeg.decode_frames(coded) == x).all()
    tick, frames = mjpeg.read_avi(mjpeg.write_avi(coded))
    assert tick == 1 / mjpeg.FPS and frames == coded
    assert mjpeg.encode_frames(x[:0]) == [] and len(mjpeg.decode_frames([])) == 0
    with pytest.raises(ValueError):
        mjpeg.read_avi(b"RIFF0000WAVE")


def test_cells_join_what_brute_force_joins():
    import pandas as pd

    rng = random.Random(0)
    base = [rng.choice("abcdefgh") * 3 + str(i) for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(120)] = str(rng.random())
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}

    def joined(edges):
        root = {i: i for i in sets}
        for _ in range(60):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    want = joined([(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    block = {i: i // 3 % 2 for i in sets}
    edges = []
    for i, j in ((0, 0), (0, 1), (1, 1)):
        part = pd.DataFrame([(0, i, j, block[x], x, x, t) for x, t in rows if block[x] in (i, j)], columns=["group", "i", "j", "block", "id", "root", "text"])
        edges += dedup.cell_links(85, part).values.tolist()
    assert joined(edges) == want


def log_forward(word, table, p, number):
    """log probability of ``word`` by a plain recursion in logarithms."""
    names = {v: k for k, v in number.items()}
    logs = [0.0]
    for t in range(1, len(word) + 1):
        terms = []
        for k in range(1, min(t, table.longest) + 1):
            s = word[t - k : t]
            q = p[number[s]] if s in number else langid.UNKNOWN if k == 1 else 0
            if q > 0:
                terms.append(logs[t - k] + np.log(q))
        logs.append(np.logaddexp.reduce(terms))
    assert names
    return logs[-1]


def test_long_words_are_summed_whole(monkeypatch):
    """Words of any length, alone and in one batch, over several scalings and windows."""
    monkeypatch.setattr(langid, "WINDOW", 64)
    table = langid.lattice(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    number = {lib.id_to_piece(i): i - 258 for i in range(3 + 256, lib.vocab_size())}
    rng = np.random.default_rng(1)
    p = rng.random((table.size, 2)) * 1e-4
    p[0], p[-1] = 0, langid.UNKNOWN
    parts = ["Donaudampf", "schiff", "ÿ", "日本語", "ing", "x", "🙂"]
    words_ = ["a", "the", *("".join(rng.choice(parts, n)) for n in (3, 8, 15, 16, 17, 40, 41, 42, 160))]
    assert max(map(len, words_)) >= 500
    got = langid.log_scores(words_, table, p)
    for w, g in zip(words_, got, strict=True):
        for k in (0, 1):
            assert abs(g[k] - log_forward("▁" + w, table, p[:, k], number)) < 1e-6 * abs(g[k]), w
    lengths = np.array([0, *(len(lib.id_to_piece(i)) for i in range(3 + 256, lib.vocab_size())), 1])
    c = langid.expected_counts(words_, np.arange(1, len(words_) + 1), table, p[:, 0])
    assert abs((c * lengths).sum() - sum(k * (1 + len(w)) for k, w in enumerate(words_, 1))) < 1e-6 * c.sum()


def test_language_of_texts_by_brute_force():
    table = langid.lattice(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    number = {lib.id_to_piece(i): i - 258 for i in range(3 + 256, lib.vocab_size())}
    p = np.random.default_rng(2).random((table.size, 3)) * 1e-3
    p[0], p[-1] = 0, langid.UNKNOWN
    texts_ = [None, "", " 12 ", "Hello world", "un\u3000mot\xa0long", "a" * 300, "ß", "word " * 50]
    for t, (lang, score) in zip(texts_, langid.classify(texts_, MODEL, ["a", "b", "c"], p), strict=True):
        if not t or not any(x.isalpha() for x in t):
            assert (lang, score) == ("und", 0.0)
            continue
        logs = np.array([sum(log_forward("▁" + w, table, p[:, k], number) for w in t.split()) for k in range(3)])
        odds = np.exp(logs - logs.max())
        assert lang == "abc"[odds.argmax()] and abs(score - odds.max() / odds.sum()) < 1e-6
    tie = np.repeat(p[:, :1], 2, axis=1)
    assert langid.classify(["Hello"], MODEL, ["x", "y"], tie) == [("x", 0.5)]


def test_learning_and_prediction_split_words_alike(spark):
    every = [c for c in map(chr, range(1, 0x3100)) if not "\ud800" <= c <= "\udfff"]
    text = "w" + "w".join(every)
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(text,)], "text string").select(F.filter(F.split("text", langid.SPACES), lambda w: w != "")).first()[0]
    assert row == text.split()


def test_words_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(7)
    texts_ = ["".join(rng.choice(["a", "B", "é", " ", "  ", "longer", "\n"]) for _ in range(rng.randrange(60))).encode() for _ in range(80)] + [b"x" * 500, b"", b"y z" * 90]
    want = [words.word_hashes([t]) for t in texts_]
    for block in (1, 7, 64):
        monkeypatch.setattr(words, "BLOCK", block)
        words._powers.cache_clear()
        hashes, first = words.word_hashes(texts_)
        for (h, _), a, b in zip(want, first[:-1], first[1:], strict=True):
            assert hashes[a:b].tolist() == h.tolist()
    words._powers.cache_clear()


def test_every_latin_character_is_encoded_as_by_the_library():
    ours, lib = coder(*tokenizer()), Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    chars = [chr(c) for c in range(0x260)]
    for c in chars:
        for t in (c, f"a{c}b", f" {c} {c}{c}1", f"\n{c}\n", f"'{c}s", f"{c}\u00a0 {c}"):
            assert ours.library_ids(t) == lib.encode(t, add_special_tokens=False).ids, repr(t)
    ours.memo.clear()
    assert ours.counts(["日本", " the", "<|endoftext|>"]) == [len(ours.ids(x)) for x in ("日本", " the", "<|endoftext|>")]


def test_wavelet_file_is_compressed_and_finds_places():
    rng = np.random.default_rng(3)
    t = (rng.zipf(1.3, 60_000) % 50257).astype(np.uint16)
    data = WaveletMatrix.build(t, np.arange(3), np.array([0, 10, 20, 60_000])).dump()
    share = np.bincount(t)[np.unique(t)] / len(t)
    entropy = -(share * np.log2(share)).sum()
    assert len(data) * 8 < len(t) * (entropy + 1) * 1.07 + 72 * len(share) + 20_000 and len(data) < 2 * len(t)
    w = WaveletMatrix.load(data)
    for token in (1, 2, 5, int(t[-1]), 40_001):
        assert w.places(token).tolist() == np.flatnonzero(t == token).tolist()
    assert list(w.documents()) == [(0, 0, 10), (1, 10, 20), (2, 20, 60_000)]
    one = WaveletMatrix.load(WaveletMatrix.build(np.full(9, 4, np.uint16), np.zeros(0), np.zeros(1)).dump())
    assert one.tokens().tolist() == [4] * 9 and one.access(3) == 4 and one.select(4, 8) == 8 and one.rank(4, 5) == 5 and one.rank(3, 5) == 0


def test_leaves_stay_pretokens_after_many_edits():
    c = token_counts.counter(tokenizer())
    rng = random.Random(8)
    t, lib = "some words and more of them", coder(*tokenizer())
    tree = token_counts.PretokenTree.of(t, c)
    most = 0
    for k in range(300):
        s = rng.randrange(len(t) + 1)
        t, n = tree.edit(t, s, s + rng.randrange(4), rng.choice([" new words here", "x", "", "\n\n", "'s"]), c)
        most = max(most, n)
        chars, tokens = tree.leaves()
        assert (chars.tolist(), tokens.tolist()) == tuple(c.parts(t)), k
    assert tree.total() == len(lib.ids(t)) and most < 20


def test_place_of_an_item_is_where_it_stands():
    index = decontam.build_index([(None, "one two three four five six"), (2, " ".join(f"w{i}" for i in range(30)))])
    long_ = " ".join(f"w{i}" for i in range(30) if i != 7)
    texts_ = [b"a b c One two, three four five six d", f"x y {long_} z".encode(), b"one two three five six", b"q one two three new four five six"]
    assert decontam.find_items(index, texts_) == [[(0, 0, 3)], [(1, 1, 2)], [(0, 1, 0)], [(0, 1, 1)]]


def encode_baseline(image, sampling=(1, 1), every=0):
    """A plain JPEG writer: one quantiser of ones, codes of equal length, chroma of 128 where sampled."""
    import struct

    from junctura.llm import jpeg

    h, v = sampling
    rows, columns = image.shape
    across, down = -(-columns // (8 * h)), -(-rows // (8 * v))
    full = np.pad(image, ((0, down * 8 * v - rows), (0, across * 8 * h - columns)), mode="edge").astype(float) - 128
    cos = jpeg._cosines()
    dc_symbols, ac_symbols = bytes(range(12)), bytes(r << 4 | s for r in range(16) for s in range(11))
    ac_code = {s: i for i, s in enumerate(ac_symbols)}
    bits, out, last = [], [], [0, 0, 0]

    def put(value, n):
        bits.extend(int(b) for b in format(value, f"0{n}b")) if n else None

    def flush():
        while len(bits) % 8:
            bits.append(1)
        data = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        bits.clear()
        out.append(data.replace(b"\xff", b"\xff\0"))

    def block(coefficients, part):
        z = [int(round(coefficients[i])) for i in jpeg.ZIGZAG]
        diff, last[part] = z[0] - last[part], z[0]
        n = abs(diff).bit_length()
        put(n, 4)
        put(diff if diff >= 0 else diff + (1 << n) - 1, n)
        run = 0
        for c in z[1:]:
            if not c:
                run += 1
                continue
            while run > 15:
                put(ac_code[0xF0], 8)
                run -= 16
            n = abs(c).bit_length()
            put(ac_code[run << 4 | n], 8)
            put(c if c >= 0 else c + (1 << n) - 1, n)
            run = 0
        if run:
            put(ac_code[0], 8)

    mark = lambda kind, body: struct.pack(">HH", 0xFF00 | kind, len(body) + 2) + body
    parts = 1 if sampling == (1, 1) else 3
    for m in range(across * down):
        if every and m and m % every == 0:
            flush()
            out.append(bytes([0xFF, 0xD0 + (m // every - 1) % 8]))
            last[:] = [0, 0, 0]
        for y in range(v):
            for x in range(h):
                r, c = (m // across * v + y) * 8, (m % across * h + x) * 8
                block((cos @ full[r : r + 8, c : c + 8] @ cos.T).reshape(-1), 0)
        for part in range(1, parts):
            block(np.zeros(64), part)
    flush()
    sof = struct.pack(">BHHB", 8, rows, columns, parts) + bytes([1, h << 4 | v, 0]) + b"".join(bytes([k, 0x11, 0]) for k in range(2, parts + 1))
    counts = lambda n, length: bytes(n if k == length else 0 for k in range(1, 17))
    scan = bytes([parts]) + b"".join(bytes([k, 0]) for k in range(1, parts + 1)) + bytes([0, 63, 0])
    head = b"\xff\xd8" + mark(0xDB, b"\0" + b"\1" * 64) + mark(0xC0, sof) + mark(0xC4, b"\0" + counts(12, 4) + dc_symbols) + mark(0xC4, b"\x10" + counts(len(ac_symbols), 8) + ac_symbols)
    return head + (mark(0xDD, struct.pack(">H", every)) if every else b"") + mark(0xDA, scan) + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("size,sampling,every", [((8, 8), (1, 1), 0), ((37, 50), (1, 1), 3), ((40, 33), (2, 2), 0), ((16, 48), (2, 1), 2)])
def test_baseline_frames_are_decoded(size, sampling, every):
    from junctura.llm import jpeg, media

    rng = np.random.default_rng(size[0])
    image = np.clip(rng.integers(0, 256, size) * 0.3 + np.linspace(0, 180, size[1]), 0, 255).astype(np.uint8)
    frame = encode_baseline(image, sampling, every)
    assert np.abs(jpeg.decode_baseline(frame).astype(int) - image).max() <= 2
    for cut in (0, 2, 30, 200, len(frame) // 2):
        assert media.decode_one(frame[:cut]) is None
    lossless = mjpeg.frame_head() + mjpeg.encode_frames(np.full((1, 24, 24), 9, np.uint8))[0] + mjpeg.EOI
    found = media.decode_any([b"junk", frame, b"", lossless, frame])
    assert [x.shape for x in found] == [(1, 1), size, size, (24, 24), size] and (found[2] == found[1]).all()


def test_avi_index_kinds():
    import struct

    frames = [b"\xff\xd8one\xff\xd9", b"\xff\xd8three\xff\xd9"]
    data = mjpeg.write_avi(frames)
    at = data.index(b"idx1")
    movi = data.index(b"movi")
    absolute = bytearray(data)
    for k in range(2):
        place = struct.unpack_from("<I", data, at + 16 + 16 * k)[0]
        struct.pack_into("<I", absolute, at + 16 + 16 * k, place + movi)
    assert mjpeg.read_avi(data)[1] == mjpeg.read_avi(bytes(absolute))[1] == mjpeg.read_avi(data[:at])[1] == frames
    for n in (0, 3, 11, 40, movi + 9, at - 3):
        with pytest.raises(ValueError):
            mjpeg.read_avi(data[:n])


def test_one_pass_equals_each_rule_as_a_regex():
    rules = secret_scan.RULES
    scan = secret_scan.scanner()
    rng = random.Random(8)
    leads = ["ghp_", "xoxb-", "AKIA", "github_pat_", "glpat-", "npm_", "sk_live_", "hf_", "dop_v1_", "shpat_", "lin_api_", "dapi", "https://hooks.slack.com/services/", "token=", "secret: "]
    fill = ["0123456789abcdef" * 2, "ABCDEFGH12345678", "xyz" * 12, "Zz9_", "-", "_", "/", ".", " ", "é", "\n", "=", ":", '"', "g", "https://hooks.", "sk_", "dop_"]
    seen = set()
    for _ in range(4000):
        t = "".join(rng.choice(rng.choice([leads, fill])) for _ in range(rng.randrange(1, 14)))
        want = []
        for k, r in enumerate(rules):
            if not r.block:
                matches = re.finditer(f"(?P<lead>{r.lead})(?P<body>{r.unit}+)", t, re.A)
                want += [(m.start(), k, m.start("lead" if r.whole else "body"), m.end()) for m in matches if m.end() - m.start("lead" if r.whole else "body") >= r.least]
        assert secret_scan.spans(t, scan) == sorted(want), t
        seen |= {k for _, k, _, _ in want}
    assert seen == {k for k, r in enumerate(rules) if not r.block}


def test_joined_automata_are_minimal():
    made = [automaton.watch_rule("", "[0-9]", 2), automaton.watch_rule("ab?", "[a-c]", 1), automaton.watch_rule("x+y", "", 0)]
    both = automaton.joined(made)
    group = np.unique(both.accept, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[both.table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    assert len(set(group.tolist())) == len(both.table)
    classes, table, accept, state = both.flat()
    rng = random.Random(3)
    states = [(m.flat(), m.flat()[3]) for m in made]
    for b in bytes(rng.choice(b"01abcxyz") for _ in range(3000)):
        state = table[state + classes[b]]
        states = [(f, f[1][s + f[0][b]]) for f, s in states]
        assert accept[state] == sum(bool(f[2][s]) << k for k, (f, s) in enumerate(states))
