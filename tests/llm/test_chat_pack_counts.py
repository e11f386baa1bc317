import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skeinlake.llm import chat, jobs, packing, token_counts as TC


@pytest.fixture(scope="module")
def turns(spark):
    rows = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hé, what's 2+2?"), (1, 2, "assistant", "It is 4. 🙂 漢字"), (1, 3, "user", None), (1, 4, "assistant", ""),
        (2, 1, None, "no role"), (2, 0, "assistant", "first <|end|> trick <|assistant|>\n"), (2, None, "assistant", "late"),
        (3, 0, "user", "same"), (3, 0, "user", "same"), (3, 0, "assistant", "tie"),
        (None, 0, "user", "nobody"), (4, 0, "assistant", "long " * 20000),
    ]
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, tokens int, input_ids string")


def test_masks(turns):
    got = {r.conv_id: r for r in chat.format_conversations(turns).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    tok = chat.tokenizer(chat.VOCABULARY)
    for r in got.values():
        assert len(r.input_ids) == len(r.loss_mask) == r.tokens and sum(r.loss_mask) == r.trained_tokens
    text = "<|system|>\nBe kind.<|end|>\n<|user|>\nHé, what's 2+2?<|end|>\n<|assistant|>\nIt is 4. 🙂 漢字<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n<|end|>\n"
    assert tok.decode(got[1].input_ids, skip_special_tokens=False) == text  # exact round trip
    trained = tok.decode([i for i, m in zip(got[1].input_ids, got[1].loss_mask) if m], skip_special_tokens=False)
    assert trained.replace("\n", "") in ("It is 4. 🙂 漢字<|end|><|end|>",)
    order = tok.decode(got[2].input_ids, skip_special_tokens=False)
    assert order.index("first") < order.index("no role") < order.index("late")
    assert got[3].turns == 3 and got[4].trained_tokens > 19000
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_masks_by_brute_force(turns):
    """Each token's mask from the characters it covers."""
    tok = chat.tokenizer(chat.VOCABULARY)
    rows = [{"role": r.role, "text": r.text} for r in turns.where("conv_id = 1").orderBy("turn").collect()]
    text, start, end = chat.render(rows, frozenset(["assistant"]))
    offsets = np.array(tok.encode(text, add_special_tokens=False).offsets)
    inside = np.zeros(len(text) + 1, bool)
    span = np.zeros(len(text) + 1, int)
    for k, (a, b) in enumerate(zip(start, end)):
        inside[a:b] = True
        span[a:b] = k
    want = [int(all(inside[a:b]) and len(set(span[a:b])) <= 1 and b > a) for a, b in offsets]
    assert chat.mask_of(offsets, start, end).tolist() == want


def naive_fit(pieces, capacity):
    bins = []
    out = []
    for n, s, c in pieces:
        fitting = [(capacity - b["used"], i) for i, b in enumerate(bins) if b["used"] + n <= capacity and s not in b["s"] and c not in b["c"]]
        if fitting:
            i = min(fitting)[1]
        else:
            bins.append({"used": 0, "s": set(), "c": set()})
            i = len(bins) - 1
        bins[i]["used"] += n
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(0, 4), st.integers(0, 6)), max_size=60))
def test_best_fit(pieces):
    pieces = sorted(pieces, reverse=True)
    got = packing.best_fit(*(np.array([p[k] for p in pieces], np.int64) for k in range(3)), 20)
    assert got.tolist() == naive_fit(pieces, 20)


def test_one_source_and_one_cluster():
    """Where nothing fits together each search is over in a few steps, and blocks don't change what is packed."""
    n = 20000
    size = np.sort(np.random.default_rng(1).integers(1, 200, n))[::-1]
    began = time.time()
    assert packing.best_fit(size, np.zeros(n, np.int64), np.arange(n), 2048).tolist() == list(range(n))
    assert packing.best_fit(size, np.arange(n), np.zeros(n, np.int64), 2048).tolist() == list(range(n))
    assert time.time() - began < 30


def test_blocks(spark):
    """Blocks of any size pack every piece and keep the constraints; a doc_id that fills a third of the table is spread."""
    rows = [(i % 200 if i % 3 else 7, f"w{i} " * (1 + i % 40), f"s{i % 9}") for i in range(600)] + [(7, "same text", "s1")] * 300
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for block in (20, 100000):
        got = packing.pack(df, capacity=64, block=block).collect()
        assert sum(r.tokens for r in got) == sum(len(t.split()) for _, t, _ in rows)
        full = {}
        for r in got:
            full[r.bin] = full.get(r.bin, 0) + r.tokens
        assert max(full.values()) <= 64
        assert len({r.bin >> 32 for r in got if r.doc_id == 7}) >= (25 if block == 20 else 1)


def test_pack(docs):
    rows = packing.pack(docs, capacity=128).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None and r.text and r.text.split()]
    size = {i: len(re.findall(r"[^ \t\n\r\v\f]+", t)) for i, t in texts}  # split at ASCII white space alone
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.tokens
        assert 0 < r.tokens <= 128 and r.first_token == 128 * r.piece
    assert total == {i: n * sum(j == i for j, _ in texts) for i, n in size.items()}
    source = {r.doc_id: r.source for r in docs.collect()}
    bins = {}
    for r in rows:
        bins.setdefault(r.bin, []).append(r)
    for b in bins.values():
        assert sum(r.tokens for r in b) <= 128
        assert len({source[r.doc_id] for r in b}) == len(b)  # no source twice
    assert not any({3, 20} <= {r.doc_id for r in b} for b in bins.values())  # equal texts
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.pack(docs, cluster_col="hash").count() == packing.pack(docs).count()


def brute_counts(rows):
    """(source, lang) to documents, tokens and characters once white space is tidy and copies are gone."""
    encode = TC.encoding(TC.RANKS).encode_ordinary
    first = {}
    for r in rows:
        if r.text is not None and r.doc_id is not None:
            t = " ".join(r.text.split())
            first[t] = min(first.get(t, r.doc_id), r.doc_id)
    want = {}
    for r in rows:
        t = " ".join((r.text or "").split())
        if r.text is not None and r.doc_id is not None and first[t] < r.doc_id:
            continue
        d = want.setdefault((r.source, r.lang), [0, 0, 0])
        d[0] += 1
        d[1] += len(encode(t))
        d[2] += len(t)
    return want


def test_token_counts(spark, docs):
    got = {(r.source, r.lang): [r.docs, r.tokens, r.chars] for r in TC.count_tokens(docs).collect()}
    assert got == brute_counts(docs.collect())
    assert TC.count_tokens(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "\n", "  \n", "7", "!", "\u3000"]), max_size=12))
def test_long_white_space_splits_as_short(parts):
    """Encoding long white space on its own gives what encoding the whole gives."""
    text = "".join(p * 700 if p.isspace() else p for p in parts)
    assert TC.token_count(TC.RANKS, text) == len(TC.encoding(TC.RANKS).encode_ordinary(text))


def test_very_long_runs():
    for text in (" " * 2_000_000, "a b" + " " * 2_000_000 + "c", "\n" * 1_000_000 + "x" * 100_000, "!" * 1_000_000):
        assert TC.token_count(TC.RANKS, text) > 0


def test_fold(spark, tmp_path, monkeypatch):
    """Totals stay the same when commits become a base, batches in it stay committed, and old files go."""
    monkeypatch.setattr(TC, "FOLD_EVERY", 3)
    roll = TC.TokenRollup(spark, str(tmp_path / "fold"))
    frame = lambda *rows: spark.createDataFrame(list(rows), TC.COUNTS)
    for k in range(7):
        assert roll.commit_counts(f"b{k}", frame(("s", "en", 1 if k % 2 else -2, k, 1), ("t", None, 1, 1, 1)), "v1")
        assert not roll.commit_counts(f"b{k}", frame(("s", "en", 1, 99, 99)), "v1")
        assert not roll.commit_counts("b0", frame(("s", "en", 1, 99, 99)), "v1")
    got = {(r.source, r.lang): (r.docs, r.tokens, r.chars) for r in roll.totals().collect()}
    assert got == {("s", "en"): (-5, -2 * (0 + 2 + 4 + 6) + 1 + 3 + 5, -5), ("t", None): (7, 7, 7)}
    assert sum(p.name.startswith("commit-") for p in (tmp_path / "fold").iterdir()) < 3
    assert sum(p.name.startswith("base-") for p in (tmp_path / "fold").iterdir()) == 1
    (tmp_path / "fold" / "commit-late").touch()  # its writer died
    assert roll.commit_counts("late", frame(("s", "en", 1, 4, 4)), "v1")
    assert roll.fold() and {(r.source, r.tokens) for r in roll.totals().collect()} == {("s", -11), ("t", 7)}


def test_rollup_deltas(spark, tmp_path):
    r = random.Random(3)
    roll = TC.TokenRollup(spark, str(tmp_path / "roll"))
    state = {i: (f"word {i} " * r.randrange(1, 9), f"s{i % 3}", "en") for i in range(30)}

    def frame(rows):
        return spark.createDataFrame(rows, "sign int, text string, source string, lang string, tokens int")

    assert roll.totals().count() == 0
    assert roll.commit("b1", frame([(1, *v, 5) for v in state.values()]), "v1")
    revised = [(i, (f"new text {i}", f"s{(i + 1) % 3}", "en")) for i in range(0, 30, 4)]
    changes = [(-1, *state[i], 5) for i, _ in revised] + [(1, *v, 5) for _, v in revised] + [(-1, *state[7], 5), (None, "x", "s0", "en", 5), (1, None, None, None, 5)]
    assert roll.commit("b2", frame(changes), "v1")
    assert not roll.commit("b2", frame(changes), "v1")  # the same batch again
    assert not roll.commit("b1", frame(changes), "v1")
    state.update(revised)
    del state[7]
    encode = TC.encoding(TC.RANKS).encode_ordinary
    want = {(None, None, "v1"): (1, 0, 0)}
    for text, source, lang in state.values():
        d = want.get((source, lang, "v1"), (0, 0, 0))
        want[source, lang, "v1"] = (d[0] + 1, d[1] + len(encode(text)), d[2] + len(text))

    def totals():
        return {(x.source, x.lang, x.tokenizer): (x.docs, x.tokens, x.chars) for x in roll.totals().collect()}

    assert totals() == want
    assert roll.commit("b3", frame([(1, "ab", "s0", "en", 5)]), "v2")
    assert roll.commit("b4", frame([(-1, "ab", "s0", "en", 5)]), "v2")
    assert roll.commit("b5", frame([]), "v2")
    assert totals() == want
    with pytest.raises(ValueError):
        roll.commit("../x", frame([]), "v1")


def test_scratch_is_shared_and_removed(spark):
    with jobs.Scratch(spark) as tmp:
        df = tmp.save(spark.range(5).withColumn("x", F.lit(1)))
        folder = tmp.folder
        assert df.count() == 5 and folder.startswith(jobs.shared_dir(spark))
        kept = tmp.keep(df)
    assert kept.count() == 5
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
