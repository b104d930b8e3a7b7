"""Mixing, packing, personal data, substrings and fingerprints against plain loops, and the edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docattr.llm import mixing, packing, pii, substrings, syncmers

DOCS = "doc_id long, text string, source string, lang string, size long, words string"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, s, "xx", 7, "clash") for i, t, s in rows], DOCS)


def corpus(n=60, seed=4):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    shared = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(18, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 50)))]
        parts += rnd.sample(shared, rnd.randint(0, 2)) + [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 30)))]
        rows.append((i, " \n".join(parts), rnd.choice(["a", "a", "a", "b", None, "c"])))
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, " \t ", None), (n + 3, "same same " * 40, "a"), (None, "no id here", "c")]
    rows.append(rows[3])
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(4)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- mixing -------------------------------------------------------------------------------


def test_targets_are_shared_by_weight_up_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 5)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # 1.5 x 2015 words; a and null reach twice their size, b and c share the rest 1 to 2, c stops at 2000
    assert got["a"] == 20 and got[None] == 10 and got["c"] == pytest.approx(1995) and got["b"] == pytest.approx(997.5)
    assert sum(got.values()) == pytest.approx(1.5 * 2015)


def test_every_source_gets_its_target(docs, rows):
    plan = mixing.plan(docs).collect()
    assert len(plan) == len(rows)
    by_source = {}
    for r in plan:
        by_source.setdefault(r.source, []).append(r)
    for members in by_source.values():
        assert abs(sum(r.taken for r in members) - members[0].target) <= len(by_source) + 1
        assert sum(r.size for r in members) == members[0].source_size
    assert all(0 <= r.taken <= 2 * r.size for r in plan)
    assert sum(r.taken for r in plan) == int(1.5 * sum(len(word_list(t)) for _, t, _ in rows))
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))


def test_sources_advance_together(docs):
    """At any place of the stream the sources' shares lie within one document of their targets."""
    plan = [r for r in mixing.plan(docs).collect() if r.position is not None]
    total, longest = sum(r.taken for r in plan), max(r.size for r in plan)
    half = [r for r in plan if r.position < total / 2 and r.source == "a"]
    target = next(r.target for r in plan if r.source == "a")
    assert sum(min(r.taken, r.size) for r in half) >= target / 2 - 4 * longest


def test_the_mix_holds_what_the_plan_takes(docs):
    taken = {}
    for r in mixing.plan(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(word_list(r.text))
    assert got == {k: v for k, v in taken.items() if v}


def test_mixing_nothing(empty):
    assert mixing.plan(empty).collect() == [] and mixing.mix(empty).collect() == []


# --- packing ------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_tournament_tree_finds_the_first_fit(lengths):
    lengths.sort(reverse=True)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], []
    for n in lengths:
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(100)
        want.append((at, 100 - room[at]))
        room[at] -= n
    assert list(zip(bins, offsets, strict=True)) == want


def test_fast_and_slow_encoder_agree():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["", "Ein Wort", "  \n\t a b ", "<|endoftext|> x", "a" * 5000, " " * 5000 + "x", "日本語 😀 é", "\x00�"]
    for text in texts:
        assert packing.encode(text).tolist() == [*slow.encode(text, add_special_tokens=False).ids, 0]


def test_every_token_lies_in_one_piece(docs, rows):
    pytest.importorskip("public_tokenizers")
    pieces = packing.pack(docs, size=64, group_docs=16).collect()
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for i, text, _ in rows:
        ids = packing.encode(text)
        own = by_doc[(i, len(ids))]
        copies = sum(1 for r in rows if r[0] == i)
        assert sum(p.length for p in own) == copies * len(ids)
        for p in own:
            assert p.ids_crc32 == zlib.crc32(ids[p.start:p.start + p.length].astype("<u4").tobytes())
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for members in sequences.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == members[0].sequence_tokens <= 64
    filled = sum(p.length for p in pieces)
    assert filled / (64 * len(sequences)) > 0.9


def test_packing_nothing(empty):
    pytest.importorskip("public_tokenizers")
    assert packing.pack(empty).collect() == []


# --- personal data ------------------------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text):
    found = []
    for number, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), number, m.end()))
    return [f"{list(PLAIN)[n]}:{a}:{b}" for a, n, b in sorted(found)]


PERSONAL = [
    "mail a.b+c@x-y.example.com, or x@y", "a@b.c_d@e.f g@h.i-j@k.l", "é 10.0.0.255 256.1.1.1 1.2.3.4.5.6.7.8 000255.1.1.1 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111", "+1 (555) 010-9999. +12 +1234567890 +1 23 4567890123456 x",
    "card+49 30 1234567 10.1.1.1@h.de", "", None, "a" * 3000 + "@" + "b" * 3000, "1" * 5000, "1." * 3000, "+" * 2000 + "1 " * 2000,
    "x@" * 3000 + "y.z", "😀 q@r.st 😀 +1 (555) 010-9999",
]


def test_base_spans(spark):
    docs = frame(spark, list(zip(range(len(PERSONAL)), PERSONAL, ["s"] * len(PERSONAL), strict=True)))
    for r in pii.report(docs).collect():
        want = plain_spans(PERSONAL[r.doc_id])
        assert [s for s in r.spans.split(",") if s] == want
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in PLAIN]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+- (é4", max_size=60), min_size=1, max_size=8))
def test_base_spans_of_any_text(spark, texts):
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    for r in pii.report(docs).collect():
        assert [s for s in r.spans.split(",") if s] == plain_spans(texts[r.doc_id])


def plain_terms(texts):
    """Places of the disclosing terms of every text, by counting documents of every pair."""
    held = [{w.lower() for w in re.split(r"[\x20\x09-\x0D]", t or "") if re.search(r"[^\W\d_]", w) and not re.search("[0-9@]", w)} for t in texts]
    entities = {}
    for i, t in enumerate(texts):
        for s in plain_spans(t):
            kind, a, b = s.split(":")
            entities.setdefault((kind, t[int(a):int(b)]), set()).add(i)
    total, told = len(texts), set()
    for docs in entities.values():
        for term in set().union(*(held[i] for i in docs)) if len(docs) < total else ():
            holders = {i for i, h in enumerate(held) if term in h}
            pmi = math.log2(total * len(holders & docs) / (len(docs) * (len(holders) + 1)))
            if pmi / math.log2(total / len(docs)) >= 0.9 - 1e-9:
                told.add(term)
    return [[f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "") if m.group().lower() in told] for t in texts]


def test_terms_that_disclose_an_entity(spark):
    """Zorblatt stands in documents of one address only, wherever in them; 'call' stands everywhere."""
    rows = [(i, f"Please call Zorblatt {'so it goes ' * 40} at q@corp.example.com number {i}, ZORBLATT\tor", "s") for i in range(4)]
    rows += [(10 + i, f"please call me at p{i}@corp.example.com", "s") for i in range(4)]
    rows += [(20 + i, "please call at noon so it goes", "s") for i in range(60)]
    docs = frame(spark, rows)
    text = {i: t for i, t, _ in rows}
    for r in pii.report(docs).collect():
        terms = [s.split(":") for s in r.spans.split(",") if s.startswith("term")]
        assert [text[r.doc_id][int(a):int(b)] for _, a, b in terms] == (["Zorblatt", "number", "ZORBLATT", "or"] if r.doc_id < 10 else [])
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[0] == f"Please call [TERM] {'so it goes ' * 40} at [EMAIL] [TERM] 0, [TERM]\t[TERM]"
    assert clean[11] == "please call me at [EMAIL]" and clean[20] == text[20]
    assert pii.redact(docs).columns == docs.columns
    # above the second threshold terms go
    assert {r.doc_id: r.text for r in pii.redact(docs, remove=0.91).collect()}[1] == f"Please call  {'so it goes ' * 40} at [EMAIL]  1, \t"


def test_terms_equal_plain_counts(spark):
    """Shared and lone entities, several in one document, terms far from them and in texts without any; equal rows count each."""
    rng = random.Random(5)
    rare = [f"Rare{chr(97 + i % 26)}{chr(97 + i // 26)}É" for i in range(120)]
    texts = []
    for i in range(1100):
        words = [rng.choice(["the", "of", "and", "a4", "x@y", "plain"]) for _ in range(rng.randrange(12))]
        if i % 20 == 0:
            # most documents of an address hold its own word, too
            own = rng.randrange(30)
            words += [f"m{own}@h.de", f"10.0.0.{rng.randrange(9)}"] + [f"Own{chr(97 + own % 26)}"] * rng.randrange(3)
        words += rng.choices(rare, k=2 if i % 20 == 0 else i % 9 == 0)
        rng.shuffle(words)
        texts.append(rng.choice([" ", "  ", "\n\t"]).join(words))
    texts += [texts[0]] * 3 + [None, "", " ", "Rareaaé " * 500]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    want = plain_terms(texts)
    assert sum(map(len, want)) > 20
    got = {r.doc_id: ([s for s in r.spans.split(",") if s.startswith("term")], r.n_term) for r in pii.report(docs).collect()}
    assert got == {i: (w, len(w)) for i, w in enumerate(want)}
    # equal rows are documents of their own and get the same spans
    twice = [(i // 2, texts[i // 2], "s") for i in range(2 * len(texts))]
    want = plain_terms([t for _, t, _ in twice])
    rows = sorted((r.doc_id, r.spans) for r in pii.report(frame(spark, twice)).collect())
    assert [[s for s in x.split(",") if s.startswith("term")] for _, x in rows] == want


def test_redaction_of_edges(spark, docs, empty):
    assert pii.redact(empty).collect() == [] and pii.report(empty).collect() == []
    assert pii.redact(docs).count() == docs.count()
    # kinds overlap: the longer span from the same start is replaced; equal rows are redacted alike
    both = frame(spark, [(1, "at 10.1.1.1@h.de now", "s")] * 2 + [(1, "at noon", "s"), (None, "a@b.co", "s")])
    assert sorted(r.text for r in pii.redact(both).collect()) == ["[EMAIL]", "at [EMAIL] now", "at [EMAIL] now", "at noon"]


def test_overlapping_spans_leave_no_tail(spark):
    texts = ["a +49 12345678901@mail.com b", "4111 1111 1111 111 1.2.3.4 c", "10.1.1.1@h.de +49 12345678901@mail.com", "+49 1234567890 a@b.co"]
    got = {r.doc_id: r.text for r in pii.redact(frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {0: "a [PHONE] b", 1: "[CARD] c", 2: "[EMAIL] [PHONE]", 3: "[PHONE] [EMAIL]"}


# --- substrings ---------------------------------------------------------------------------


def plain_removal(rows, window):
    """(n_words, n_removed, digest) per row: windows seen before in the order of ids, nulls last."""
    seen, out = set(), {}
    unique = sorted({(i is None, i or 0, t or "") for i, t, _ in rows})
    for none, i, text in unique:
        words = word_list(text)
        stay = [True] * len(words)
        for a in range(len(words) - window + 1):
            key = tuple(words[a:a + window])
            if key in seen:
                stay[a:a + window] = [False] * window
            seen.add(key)
        kept = " ".join(w for w, s in zip(words, stay, strict=True) if s)
        out[(None if none else i, len(words), stay.count(False), hashlib.sha256(kept.encode()).hexdigest())] = True
    return set(out)


@pytest.mark.parametrize("limit", [2000, 1])
def test_repeated_passages_go(docs, rows, limit):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(docs, shard_segments=limit).collect()}
    assert got == plain_removal(rows, 20)


def test_repeated_passages_of_short_windows(docs, rows):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.report(docs, 6, 3, 3).collect()}
    assert got == plain_removal(rows, 6)


def test_rows_without_id_are_documents_of_their_own(spark, monkeypatch):
    """Neither anchors nor words of one of them reach the others, and equal rows go on once."""
    rnd = random.Random(3)
    shared = " ".join(f"s{i}" for i in range(30))
    texts = [" ".join([*(f"v{rnd.randint(0, 10**6)}" for _ in range(20)), shared, f"e{i}", *(f"w{i}x{j} w{j}" for j in range(15))])
             for i in range(8)]
    rows = [(key, t, "s") for i, t in enumerate(texts) for key in (None, 7, i) for _ in range(3)]
    seen, whole = [], substrings.repeated_spans
    monkeypatch.setattr(substrings, "repeated_spans", lambda t, *a: seen.append(t.collect()) or whole(t, *a))
    got = substrings.report(frame(spark, rows).repartition(4)).collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == plain_removal(rows, 20)
    keys = [(r.k1, r.k2) for r in seen[0]]
    assert len(keys) == len(set(keys))
    for r in seen[0]:
        assert set(r.kept) <= set(substrings._anchors(r.text.encode().split(), 20, 8)[0].tolist())


def test_no_passages(empty):
    assert substrings.report(empty).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=15), max_size=4), st.text("abc", max_size=25))
def test_matching_statistics(passages, text):
    automaton = substrings.SuffixAutomaton()
    for p in passages:
        automaton.add(p)
    want = [max((n for n in range(i + 2) if any(text[i + 1 - n:i + 1] in p for p in passages)), default=0) for i in range(len(text))]
    assert list(automaton.stream(text)) == want


def test_known_passages_are_removed(spark):
    passage = " ".join(f"k{i}" for i in range(30))
    docs = frame(spark, [(1, f"before {passage} after", "s"), (2, " ".join(passage.split()[:19]), "s"), (3, None, "s")])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_known(docs, [passage]).collect()}
    assert got == {1: (32, 30, "before after"), 2: (19, 0, " ".join(passage.split()[:19])), 3: (0, 0, "")}
    with pytest.raises(ValueError, match="too large"):
        substrings.remove_known(docs, [passage], most_words=10)


# --- fingerprints -------------------------------------------------------------------------


def test_anchors_are_closed_syncmers(spark):
    """The choice depends on the run alone: the minimum of the inner hashes lies at an edge."""
    text = " ".join(random.Random(1).choice("abcdefgh") + str(i % 7) for i in range(300))
    found = spark.createDataFrame([(text,)], "text string").select(syncmers.anchors("text").alias("a")).first()["a"]
    words = text.split()
    hashes = [r.h for r in spark.createDataFrame(
        [(i, *words[i:i + 3]) for i in range(len(words) - 2)], "i int, a string, b string, c string").selectExpr(
        "xxhash64(a, b, c) h", "i").orderBy("i").collect()]
    want = [i for i in range(len(words) - 7) if min(hashes[i:i + 6]) in (hashes[i], hashes[i + 5])]
    assert [a.pos for a in found] == want and 0 < len(want) < len(words)


def test_anchors_do_not_depend_on_context(spark):
    passage = " ".join(f"p{i * 7 % 41}" for i in range(40))
    rows = [(f"{a} {passage} {b}",) for a, b in (("x y", "z"), ("u v w t s", "r q"))]
    df = spark.createDataFrame(rows, "text string").select(syncmers.anchors("text").alias("a"))
    one, two = [{(x.hash, x.pos - shift) for x in r.a if shift <= x.pos <= shift + 32} for r, shift in zip(df.collect(), (2, 5), strict=True)]
    assert one and one == two


def test_every_text_with_words_has_an_anchor(spark):
    rnd = random.Random(6)
    texts = [" ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(n)) for n in range(1, 14) for _ in range(12)]
    got = syncmers.edit_report(frame(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(-1, " ", "s")])).collect()
    assert len({r.fingerprint for r in got}) == len(texts) + 1
    assert all(r.near_next == 0 for r in got)


def test_positional_matches(spark):
    text = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(text, "new words ahead " + text)], "a string, b string").select(
        syncmers.matches(syncmers.anchors("a"), syncmers.anchors("b")).alias("m"))
    shifts = {x.pos_b - x.pos_a for x in df.first()["m"]}
    assert shifts == {3}


def test_a_passage_of_long_texts_is_found(spark):
    """Likeness counts all anchors: a shared passage of 100 words of 5000 shows."""
    rnd = random.Random(9)
    own = [[f"v{rnd.randint(0, 10**7)}" for _ in range(5000)] for _ in range(2)]
    own[1][2000:2100] = own[0][700:800]
    df = spark.createDataFrame([tuple(map(" ".join, own))], "a string, b string").select(
        syncmers.anchors("a").alias("a"), syncmers.anchors("b").alias("b"))
    r = df.first()
    a, b = {x.hash for x in r.a}, {x.hash for x in r.b}
    assert len(a & b) > 10
    got = {r.doc_id: r.near_next for r in syncmers.edit_report(frame(spark, [(i, " ".join(w), "s") for i, w in enumerate(own)])).collect()}
    assert got == {0: pytest.approx(len(a & b) / len(a | b)), 1: pytest.approx(len(a & b) / len(a | b))}


def test_edit_report(spark, docs, rows):
    got = syncmers.edit_report(docs).collect()
    assert len(got) == len(rows)
    keyed = frame(spark, rows).selectExpr("doc_id", "coalesce(text, '') text", "xxhash64(coalesce(text, '')) h").collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    want = []
    for r, nxt in zip(order, order[1:] + order[:1], strict=True):
        half = len(r.text) // 2
        text = r.text[:len(r.text) - half] + nxt.text[:half]
        want.append((r.doc_id, len(r.text), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert np.mean([r.near_edited for r in got]) > np.mean([r.near_next for r in got])


def test_rows_of_one_id_are_spread(spark, monkeypatch):
    seen = []
    rows = [(None if i % 2 else 5, f"text number {i} of many", "s") for i in range(400)] + [(-2**63, "least", "s")]

    def counted(r):
        seen.append([x["count"] for x in r.filter("_ghost = 0").groupBy("_at").count().collect()])
        return r

    got = syncmers.with_next(frame(spark, rows).select("doc_id", "text"), counted, ["text"]).collect()
    keyed = frame(spark, rows).selectExpr("doc_id", "text", "xxhash64(text) h").collect()
    order = sorted(keyed, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), r.h))
    assert max(seen[0]) <= 60 and len(seen[0]) > 8
    assert {(r.text, r.next_text) for r in got} == {(a.text, b.text) for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert len(got) == len(rows)


def test_no_fingerprints_and_a_single_document(spark, empty):
    assert syncmers.edit_report(empty).collect() == []
    one = syncmers.edit_report(frame(spark, [(5, "abcd", "s")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1
