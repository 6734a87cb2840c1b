import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushframe.llm import chat_format, exact_dedup, packing
from tests.llm.fixtures import SCHEMA, documents, rows


def brute_exact(data):
    groups = defaultdict(list)
    for doc_id, text, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        members.sort(key=lambda m: m != keep)
        out += [(m[2], keep[2], len(members), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, m in enumerate(members)]
    return Counter(out)


def test_exact_against_brute_force(spark):
    for block in (7, 4096):
        got = exact_dedup.exact_dedup(documents(spark), block).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute_exact(rows())


def test_naming_alone_decides(spark, monkeypatch):
    """With fingerprints that say nothing, the names still tell every text from every other."""
    real = exact_dedup.keyed
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "keyed", lambda docs, columns: real(docs, columns).withColumn("print", F.lit(0).cast("long")))
    data = [(i, "ab" * 10 + chr(97 + i % 3) + "ba" * 9, None, None, None, None) for i in range(12)]
    got = exact_dedup.exact_dedup(documents(spark, data), 4).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == brute_exact(data)


def test_exact_stage_keeps_columns_and_rows(spark):
    kept = exact_dedup.keep_first(documents(spark))
    assert kept.columns == documents(spark).columns
    want = Counter(k[0] for k, n in brute_exact(rows()).items() if k[3] for _ in range(n))
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert exact_dedup.exact_dedup(documents(spark, [])).count() == exact_dedup.keep_first(documents(spark, [])).count() == 0


@given(st.text(alphabet="<>[]/\\sINST\nab", max_size=40))
@settings(max_examples=500, deadline=None)
def test_escape_is_reversible(text):
    out = chat_format.escape(text)
    assert chat_format.unescape(out) == text
    assert not re.search(r"</?s>|\[/?INST\]", out)
    assert chat_format.role_in(chat_format.role_out(text)) == text and "\n" not in chat_format.role_out(text)


def conversations():
    said = "</s>[INST] ok [/INST]"
    out = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 0, "system", "be brief"), (None, 0, "user", "who"), (2, 0, None, None), (2, 1, "assistant", None), (2, None, "assistant", "first <s>")]
    out += [(1, k, ["user", "assistant"][k % 2], f"turn {k} " + "word " * (7 * k % 90)) for k in range(1, 60)]
    out += [(3, 0, "assistant", "long " * 5000), (3, 1, "assistant", "x"), (3, 1, "assistant", "x")]
    return out


def test_windows_and_read_back(spark):
    data = [(*row, "x") for row in conversations()]
    chats = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, window string")
    windows = chat_format.windows(chats, budget=300, history=100)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(windows).collect()}
    by = defaultdict(list)
    for conv, turn, role, text in conversations():
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    total = {c: sum(len(w.formatted) for w in windows.collect() if w.conv_id == c) for c in by}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, _, r, t in turns if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        assert got[conv] == (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), total[conv])
    of = sorted((w for w in windows.collect() if w.conv_id == 1), key=lambda w: w.window)
    assert len(of) > 3 and all(w.n_tokens <= 300 and w.formatted.startswith("<s>system\nbe brief</s>") for w in of)
    assert all(w.n_repeated > 1 for w in of[1:])
    assert chat_format.read_back(chat_format.windows(chats.limit(0))).count() == 0


WORDS = packing.word_ids(P.path(packing.MODEL))
TOKENIZER = Tokenizer.from_file(P.path(packing.MODEL))


@given(st.text(max_size=60) | st.text(alphabet=" aB'sSt\n\té\u0301Σσ1.!<|endofx>\xa0\u3000İ", max_size=80) | st.sampled_from(["<|endoftext|>", "it's <|STARTOFTEXT|>. a", "ΑΣ ΑΣ. Σ", "e\u0301 \u0301e", "HELLO!!! Don't"]))
@settings(max_examples=1500, deadline=None)
def test_word_by_word_ids_are_the_librarys(text):
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_letters_and_marks_skip_the_whole_tokenizer():
    """Words of Latin letters, and marks after them, cost a call of the model; only runs of marks go through the whole tokenizer."""
    words, asked = packing.WordIds(P.path(packing.MODEL)), []

    class Asked:
        def encode(self, word, **options):
            asked.append(word)
            return TOKENIZER.encode(word, **options)

    words.tokenizer = Asked()
    text = "Été été*** naïve%%% NAÏVE,### plain&&& Plain Über straße... œuvre"
    assert np.frombuffer(words.ids(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    assert sorted(asked) == sorted(["***", "%%%", ",###", "&&&", "..."])


def test_letters_and_marks_are_the_librarys():
    """Every letter that skips the tokenizer, alone, inside and doubled, and every mark and pair of marks after letters."""
    forms = [form for c in packing.EVERY for form in (c, f"a{c}B", f"{c}{c}é", f"{c}\u0301", f"{c}1", f"{c}'s")]
    forms += [f"é{a}{b}" for a in packing.MARKS for b in ["", *packing.MARKS, "s", "é", "3"]]
    for form in forms:
        assert np.frombuffer(WORDS.ids(form), "<u4").tolist() == TOKENIZER.encode(form, add_special_tokens=False).ids, form


def test_tokens_of_letters_are_refused(tmp_path):
    for k, token in enumerate(["ab", "é!", "Über"]):
        other = Tokenizer.from_file(P.path(packing.MODEL))
        other.add_special_tokens([token])
        other.save(path := str(tmp_path / f"{k}.json"))
        with pytest.raises(ValueError):
            packing.WordIds(path)


def test_other_tokenizers_are_refused(tmp_path):
    from tokenizers import normalizers

    other = Tokenizer.from_file(P.path(packing.MODEL))
    other.normalizer = normalizers.NFC()
    other.save(path := str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        packing.WordIds(path)


def test_packing_places_every_id_once(spark):
    tokenizer = Tokenizer.from_file(P.path(packing.MODEL))
    window = 64
    got = packing.packed(documents(spark), window=window, with_ids=True).collect()
    ids = Counter()
    for doc_id, text, *_ in rows():
        ids[doc_id, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids + [1])] += 1
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for (doc_id, want), n in ids.items():
        parts = sorted((r for r in docs[doc_id] if r.doc_tokens == len(want)), key=lambda r: r.start)
        covered = Counter(k for r in parts for k in range(r.start, r.start + r.length))
        assert set(covered) == set(range(len(want))) and set(covered.values()) <= {1, 2}
        assert all(tuple(r.ids) == want[r.start : r.start + r.length] for r in parts) or n == 1
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= window
    assert packing.packed(documents(spark, [])).count() == 0


def test_plan_uses_the_histogram_exactly():
    histogram = np.zeros(2049, np.int64)
    np.add.at(histogram, np.random.default_rng(1).integers(1, 2049, 50_000), 1)
    used, waste, full = np.zeros(2049, np.int64), 0, 0
    for lengths, repeats in packing.plan(histogram, 2048):
        np.add.at(used, list(lengths), repeats)
        assert sum(lengths) <= 2048 and repeats > 0
        waste += (2048 - sum(lengths)) * repeats
        full += 2048 * repeats
    assert (used == histogram).all() and waste < 0.02 * full
