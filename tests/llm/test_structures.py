"""Repeats, archives, chats, language model, pipeline: small tables against brute force."""

import collections
import hashlib
import itertools
import math
import random
import tracemalloc
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import anchors, chat, components, gru, intervals, lm, repeats, warc

DOCS = "doc_id long, text string, key string, spans string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "k", "s") for i, t in enumerate(texts)], DOCS)


def test_anchors_are_the_least_of_some_stretch(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(anchors, "PART", 700)
    for data in (bytes(r.choice(b"ab") for _ in range(2500)), b"a" * 900, r.randbytes(2600)):
        h = anchors.gram_hashes(np.frombuffer(data, dtype=np.uint8))
        expected = set()
        for k in range(len(h) - anchors.STRETCH + 1):
            w = h[k:k + anchors.STRETCH]
            expected |= {k + int(i) for i in np.nonzero(w == w.min())[0]}
        assert set(anchors.find(data)[0].tolist()) == expected
    assert len(anchors.find(b"x" * 199)[0]) == 0


def test_every_string_belongs_to_one_anchor(spark, monkeypatch):
    monkeypatch.setattr(anchors, "PART", 700)
    r = random.Random(5)
    parts = [bytes(r.choice(b"ab") for _ in range(2500)), b"a" * 900, b"abc" * 300, b"x" * 199,
             r.randbytes(2600), b"y" * 200]
    begins = [sum(map(len, parts[:i])) for i in range(len(parts))]
    found = [anchors.find(p) for p in parts]
    at = np.concatenate([f[0] + b for f, b in zip(found, begins)])
    h = np.concatenate([f[1] for f in found])
    counts = [len(f[0]) for f in found]
    lo, hi = anchors.claims(at, h, np.repeat(begins, counts), np.repeat(
        [b + len(p) - anchors.MATCH for b, p in zip(begins, parts)], counts))
    got = {}
    for a, b, c in zip(at.tolist(), lo.tolist(), hi.tolist()):
        for start in range(b, c + 1):
            assert start not in got
            got[start] = a
    expected = {}
    for p, b in zip(parts, begins):
        hashes = anchors.gram_hashes(np.frombuffer(p, dtype=np.uint8))
        for s in range(len(p) - anchors.MATCH + 1):
            expected[b + s] = b + s + int(np.argmin(hashes[s:s + anchors.STRETCH]))
    assert got == expected
    # So the contexts of a text hold each of its strings once.
    texts = ["".join(r.choice("abcd é") for _ in range(n)) for n in (180, 300, 3000)]
    rows = repeats._anchor_rows(repeats._texts(docs_of(spark, texts), "doc_id", "text")).collect()
    held = collections.Counter()
    for x in rows:
        held[x["key"]] += (x["span"] & 511) - anchors.MATCH + 1
    sizes = [len(t.encode()) - anchors.MATCH + 1 for t in texts]
    assert sorted(held.values()) == sorted(n for n in sizes if n > 0)


def test_interval_expansion():
    r = random.Random(3)
    for _ in range(120):
        least = r.choice([1, 2, 3, 5, 8])
        letters = r.choice([b"ab", b"abc", b"a", bytes(range(97, 117))])
        strings = [bytes(r.choice(letters) for _ in range(r.randint(1, 25)))
                   for _ in range(r.randint(1, 12))]
        strings[-1] = strings[0] if r.random() < 0.3 else strings[-1]
        places = np.array([1000 * i for i in range(len(strings))])
        often = np.array([r.random() < 0.1 for _ in strings])
        found, twice = collections.defaultdict(set), collections.defaultdict(bool)
        for i, s in enumerate(strings):
            for k in range(len(s) - least + 1):
                found[s[k:k + least]].add(int(places[i]) + k)
                twice[s[k:k + least]] |= bool(often[i])
        expected = [[k for k in range(len(s) - least + 1)
                     if len(found[s[k:k + least]]) > 1 or twice[s[k:k + least]]] for s in strings]
        got = intervals.repeated_starts(strings, places, often, least)
        assert [g.tolist() for g in got] == expected


def brute_repeats(texts, least=200):
    data = [(t or "").encode() for t in texts]
    starts = collections.Counter(d[i:i + least] for d in data for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - least + 1):
            if starts[d[i:i + least]] > 1:
                gone[i:i + least] = b"\1" * least
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [repeats.GROUP, 2])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    r = random.Random(7)

    def fresh(n):
        return "".join(r.choice("abcdefgh é") for _ in range(n))

    shared, short, exact = fresh(420), fresh(198), fresh(200)
    texts = [None, "", "é", fresh(150), fresh(900), "a" * 350, "ab" * 260]
    for i in range(7):
        texts.append(fresh(60 + i) + shared[:420 - 13 * i] + fresh(90))
        texts.append(fresh(37) + short + fresh(30 + i))
    texts += [fresh(10) + exact, exact + fresh(300), texts[4], texts[4][:500] + "#" + texts[4][500:]]
    texts += [fresh(100) + exact[:150]] * 2  # copies of a long enough text
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"])
           for x in repeats.remove_repeats(docs_of(spark, texts)).collect()}
    for i, expected in enumerate(brute_repeats(texts)):
        assert got[i] == expected, i
    assert repeats.remove_repeats(docs_of(spark, texts).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (None, 5), (7, None)]
    edges += [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(500, 400), (400, 500)]
    parent = {}

    def top(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: top(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_archives(spark, tmp_path):
    body = "<p>é" + "x" * 5000 + "</p>"
    pages = [(3, "http://a/\r\nX: 1", body), (1, None, body), (2, "http://b", None), (5, "u", ""),
             (None, "v", body), (9, "w", "only"), (9, "w", "only"), (7, "q", "y" * 400_000)]
    frame = spark.createDataFrame([(*p, "clash") for p in pages],
                                  "page_id long, url string, html string, digest string")
    root = str(tmp_path / "out")
    index = warc.write_bundles(frame, root, frame_bytes=4096, bundle_bytes=6000)
    got = warc.read_bundles(spark, root, index).collect()
    rows = sorted(((x["page_id"] is None, x["page_id"]), x["record_type"], x["refers_to"],
                   x["payload_bytes"]) for x in got)
    size = len(body.encode())
    assert rows == sorted([((False, 3), "revisit", 1, size), ((False, 1), "response", None, size),
                           ((False, 2), "response", None, 0), ((False, 5), "revisit", 2, 0),
                           ((True, None), "revisit", 1, size), ((False, 7), "response", None, 400_000)]
                          + [((False, 9), "response", None, 4)] * 2)
    by_id = {x["page_id"]: x for x in got}
    assert by_id[1]["payload"].decode() == body and by_id[1]["url"] is None
    assert by_id[3]["url"] == "http://a/%0D%0AX:%201" and by_id[3]["payload"] is None
    # Any record by its index row alone; and frames are plain Zstandard behind one another.
    for x in index.collect():
        headers, _ = warc.read_record(root, x["bundle"], x["frame_offset"], x["frame_bytes"],
                                      x["record_offset"])
        assert warc._id_of(headers["WARC-Record-ID"]) == (
            None if x["page_id"] is None else str(x["page_id"]))
    name = index.filter("page_id = 1").first()["bundle"]
    raw = (tmp_path / "out" / name).read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\n")
    assert warc.write_bundles(frame.limit(0), root).count() == 0


def legal(roles):
    state = chat.START
    for role in roles:
        if role not in chat.NEXT[state]:
            return False
        state = role
    return not roles or state == chat.ASSISTANT


def test_role_repair_is_cheapest():
    for roles in itertools.chain(*(itertools.product((None, 1, 2, 3), repeat=n) for n in (1, 2, 3, 4))):
        steps = chat.repair(list(roles))
        out, state, cost = [], chat.START, 0
        for role, (action, inserted, after) in zip(roles, steps):
            change = chat.UNKNOWN if role is None else 0 if role == after else chat.RELABEL
            cost += change + chat.INSERT * len(inserted) + (chat.MERGE if action == "merge" else 0)
            assert action != "merge" or state == after
            out += [*inserted, *([] if action == "merge" else [after])]
            state = after
        out += chat.ENDING[state]
        cost += chat.ending_cost(state)
        assert legal(out)
        row = chat.matrix(list(roles))[chat.START]
        assert cost == min(row[s] + chat.ending_cost(s) for s in range(4))


@pytest.mark.parametrize("ranges", [1, 7])
def test_chats_in_pieces_equal_whole_ones(spark, ranges):
    r = random.Random(6)
    names = ["user", "Assistant ", "system", "human", "tool", None, "gpt"]
    turns = [(1, t, r.choice(names), f"t{t}<|im_end|>") for t in range(60)]
    turns += [(c, t, r.choice(names), f"{c}.{t}") for c in (2, 3, None) for t in range(5)]
    turns += [(4, None, "user", None), (4, 0, "user", "same"), (4, 0, "user", "same")]
    frame = spark.createDataFrame([(*t, 1) for t in turns],
                                  "conv_id long, turn long, role string, text string, part int")
    got = collections.defaultdict(list)
    for x in sorted(chat.format_chats(frame, ranges=ranges).collect(), key=lambda x: x["place"]):
        got[x["conv_id"]].append(x)
    own = collections.defaultdict(list)
    for t in sorted(turns, key=lambda t: (str(t[0]), t[1] is None, t[1] or 0, t[2] is not None,
                                          t[2] or "", t[3] or "")):
        own[t[0]].append(t)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in own.items()}
    for conv, rows in own.items():
        roles = [chat.role_of(t[2]) for t in rows]
        steps = chat.repair(roles)
        best = min(c + chat.ending_cost(s) for s, c in enumerate(chat.matrix(roles)[0]))
        spent = 0
        text = "".join(x["rendered"] for x in got[conv])
        out = [line for line in text.replace(chat.CLOSE, "\0").split("\0") if line]
        shown = [chat.NAMES[m.removeprefix(chat.OPEN).split("\n")[0]] for m in out]
        assert legal(shown) and text.count(chat.CLOSE) == len(shown) and text.endswith(chat.CLOSE)
        for x, role in zip(got[conv], roles):
            after = chat.NAMES[x["new_role"]]
            spent += chat.UNKNOWN if role is None else 0 if role == after else chat.RELABEL
            spent += chat.INSERT * x["n_inserted"] + (chat.MERGE if x["action"] == "merge" else 0)
        assert spent == best
        if ranges == 1:
            assert [x["action"] for x in got[conv]] == [s[0] for s in steps]
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_gradients_and_carried_state(monkeypatch):
    rng = np.random.default_rng(1)
    params = [p.astype(np.float64) for p in gru.init(5, np.ones(5))]
    texts = [rng.integers(0, 5, n).astype(np.int16) for n in (70, 3, 0, 41, 1)]
    monkeypatch.setattr(gru, "WINDOW", 10_000)
    whole = gru.log_likelihoods(params, texts)
    monkeypatch.setattr(gru, "WINDOW", 7)
    assert gru.log_likelihoods(params, texts) == pytest.approx(whole, rel=1e-4, abs=1e-5)
    alone = [gru.log_likelihoods(params, [t])[0] for t in texts]
    assert alone == pytest.approx(whole, rel=1e-4, abs=1e-5)
    # All classes of a next step together have probability one.
    assert sum(math.exp(gru.log_likelihoods(params, [np.array([2, k])])[0]
                        - gru.log_likelihoods(params, [np.array([2])])[0])
               for k in range(5)) == pytest.approx(1, abs=1e-5)
    x, y, begins, _ = gru.lay_out([t[:6] for t in texts], 2, 5)
    trainer = gru.Trainer(params)
    _, grads, _ = trainer.window(x, y, begins, np.zeros((2, gru.HIDDEN)))

    def loss():
        return -gru.log_likelihoods(trainer.params, [t[:6] for t in texts]).sum()

    for p, g in zip(trainer.params, grads):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p.shape)
            p[at] += 1e-3
            up = loss()
            p[at] -= 2e-3
            down = loss()
            p[at] += 1e-3
            assert (up - down) / 2e-3 == pytest.approx(g[at], rel=0.05, abs=2e-2)


def plain_window(params, x, y, reset, h):
    """The window step by step, every operation on its own."""
    rows, recurrent, out, bias = params
    n, kept = gru.HIDDEN, []
    for t in range(len(x)):
        before = h * ~reset[t][:, None]
        a, g = before @ recurrent, rows[x[t]]
        zr = 1 / (1 + np.exp(-(g[:, :2 * n] + a[:, :2 * n])))
        new = np.tanh(g[:, 2 * n:] + zr[:, n:] * a[:, 2 * n:])
        h = new + zr[:, :n] * (before - new)
        kept.append((before, a, zr, new, h))
    grads, behind = [np.zeros_like(p) for p in params], np.zeros_like(h)
    for t in range(len(x) - 1, -1, -1):
        before, a, zr, new, state = kept[t]
        z, r = zr[:, :n], zr[:, n:]
        logits = state @ out + bias
        error = np.exp(logits - logits.max(axis=1, keepdims=True))
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(len(error)), np.maximum(y[t], 0)] -= 1
        error *= (y[t] >= 0)[:, None]
        grads[2] += state.T @ error
        grads[3] += error.sum(axis=0)
        d = error @ out.T + behind
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (before - new) * z * (1 - z)
        d_r = d_new * a[:, 2 * n:] * r * (1 - r)
        d_a = np.concatenate([d_z, d_r, d_new * r], axis=1)
        grads[1] += before.T @ d_a
        np.add.at(grads[0], x[t], np.concatenate([d_z, d_r, d_new], axis=1))
        behind = (d * z + d_a @ recurrent.T) * ~reset[t][:, None]
    return h, grads, int((y >= 0).sum())


@pytest.mark.parametrize("size", [1, 40])  # 40: logits too large for exp alone
def test_windows_are_those_of_single_steps(size):
    rng = np.random.default_rng(4)
    params = [p.astype(np.float64) * size for p in gru.init(9, np.ones(9))]
    texts = [rng.integers(0, 9, n).astype(np.int16) for n in (50, 3, 1, 44, 30, 7)]
    x, y, begins, _ = gru.lay_out(texts, 4, 9)
    trainer, h = gru.Trainer(params), np.zeros((4, gru.HIDDEN))
    for at in range(0, len(x), 16):
        part = slice(at, at + 16)
        expected = plain_window(params, x[part], y[part], begins[part], h)
        h, grads, n = trainer.window(x[part], y[part], begins[part], h)
        assert n == expected[2] and np.allclose(h, expected[0])
        assert all(np.allclose(g, e, atol=1e-9) for g, e in zip(grads, expected[1]))
    # An update changes all parameters, which are one vector.
    trainer.step(grads)
    assert all(np.shares_memory(p, trainer.flat) and (p != q).any()
               for p, q in zip(trainer.params, params))


def test_windows_use_their_arrays_again():
    rng = np.random.default_rng(5)
    params = gru.init(lm.CLASSES, np.ones(lm.CLASSES))
    texts = [rng.integers(0, lm.CLASSES, n).astype(np.int16) for n in rng.integers(1, 200, 64)]
    x, y, begins, _ = gru.lay_out(texts, gru.LANES, lm.CLASSES)
    used, h = gru.Trainer(params), np.zeros((gru.LANES, gru.HIDDEN), dtype=np.float32)
    for at in range(0, 4 * gru.WINDOW, gru.WINDOW):
        part = slice(at, at + gru.WINDOW)
        # A window leaves nothing behind for the next one.
        expected = gru.Trainer(params).window(x[part], y[part], begins[part], h.copy())
        tracemalloc.start()
        h, grads, n = used.window(x[part], y[part], begins[part], h)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # Logits of all steps alone are 400 kB.
        assert not at or peak < 250_000
        assert n == expected[2] and (h == expected[0]).all()
        assert all((g == e).all() for g, e in zip(grads, expected[1]))


@pytest.mark.parametrize("size", [1, 40])
def test_scoring_in_blocks(monkeypatch, size):
    rng = np.random.default_rng(6)
    params = [p * size for p in gru.init(9, np.ones(9))]
    texts = [rng.integers(0, 9, n).astype(np.int16) for n in (50, 3, 0, 1, 44, 30, 7)]
    whole = gru.log_likelihoods(params, texts)
    monkeypatch.setattr(gru, "TOGETHER", 5)
    assert gru.log_likelihoods(params, texts) == pytest.approx(whole, rel=1e-5, abs=1e-4)


def test_classes_of_tokens():
    words = [(b"a", 5), (b"of", 3)]
    own = lm.Vocabulary(words, [(lm.ending_class(w), c, 1) for w, c in words], 1)
    for text in (None, "", "A of of unseen seen \u00e9 a", "x"):
        assert own.read(text)[0].tolist() == [
            {b"a": 0, b"of": 1}.get(w, lm.ending_class(w))
            for w in (text or "").lower().encode().split()] + [lm.END]


def test_language_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 60)
    r = random.Random(8)
    left, right = [f"al{i}" for i in range(40)], [f"bo{i}" for i in range(40)]
    texts = [" ".join(r.choices(r.choice((left, right)), k=60)) for _ in range(250)]
    texts += [None, "", "É é AL1 al1 never-seen", "rare " * 3]
    frame = docs_of(spark, texts)
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    got = {x["doc_id"]: x for x in lm.score(frame, held).collect()}
    own = [(t or "").encode().lower().split() + [None] for t in texts]
    counts = collections.Counter(
        w for i, ws in enumerate(own) if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    gain = 0
    for i, ws in enumerate(own):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        x = got[i]
        assert (x["n_tokens"], x["train_tokens"]) == (len(ws), n)
        assert x["n_known"] == sum(counts[w] > 0 for w in ws)
        assert x["base_score"] == pytest.approx(base, rel=1e-9)
        assert x["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0) and x["score"] < 0
        gain += (x["score"] - x["base_score"]) * x["held_out"]
    assert gain > 0  # held-out texts are likelier than under the base
    assert lm.score(frame.limit(0), held).count() == 0


def test_every_training_text_moves_the_weights(spark):
    classes = np.ones(lm.CLASSES)
    vocabulary = spark.sparkContext.broadcast(lm.Vocabulary([], [], 0))
    for i in range(8):
        one = docs_of(spark, [f"text number{i} of eight"])
        moved = lm.train(one, vocabulary, classes)
        assert any((a != b).any() for a, b in zip(moved, gru.init(lm.CLASSES, classes))), i


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(9)

    def text(seed, n=120):
        q = random.Random(seed)
        return " ".join(f"w{q.randint(0, 3000)}" for _ in range(n))

    item = text(77, 30)
    docs = [(0, text(1)), (1, text(1)), (2, text(2)), (2, text(2)), (3, text(3) + " " + item),
            (4, "too short"), (5, None), (6, text(6) + " password=hunter2hunter2 end"), (None, text(8)),
            (7, "é " + text(7)), (7, text(70))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), r.random()) for i, t in docs],
                                  "doc_id long, text string, lang string, source string, n_chars long, row_key double")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = frame.columns
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == before
    left = sorted(((x["doc_id"], x["text"]) for x in frame.collect()), key=str)
    assert left == sorted([(0, text(1)), (2, text(2)), (6, text(6) + " [secret] end"), (None, text(8)),
                           (7, "é " + text(7)), (7, text(70))], key=str)
    last = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
    assert len(last) == 6 and all(x["n_tokens"] == len(x["ids"]) for x in last)
