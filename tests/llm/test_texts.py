"""Pseudonyms, decontamination, line templates, secrets, packing, pages and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, ascii_words, frame, made_docs

import corpus_pipeline
from ledgerloom.llm import block_labeller as B
from ledgerloom.llm import credential_automata as S
from ledgerloom.llm import hilbert_packing as P
from ledgerloom.llm import line_templates as T
from ledgerloom.llm import pseudonyms as N
from ledgerloom.llm import spaced_seeds as D

FOLDER = "/root/testdata/sf0.001"


# --- pseudonyms


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


PRIVATE = [
    (1, "call +1 (743) 555-3824 or +49 30 1234 5678, mail re.46@mail8.example.com", "en", "s", None),
    (2, "card 4539578763621486 and 4539 5787 6362 1486, not 1234567890123456", "en", "s", None),
    (3, "born 1984-02-29, 31.12.1999 or 05/06/2001, not 2001-02-30; ssn 123-45-6789, not 000-12-3456", "en", "s", None),
    (4, "hosts 10.0.255.1 and 300.1.1.1 and 1.2.3.4.5", "en", "s", None),
    (5, "again +1 (743) 555-3824 and re.46@mail8.example.com and 4539578763621486", "en", "s", None),
]


def test_pseudonyms_undo_link_and_stay_valid(spark):
    rows = PRIVATE + ODD + [(100 + r[0], *r[1:]) for r in made_docs(10)]
    first = N.pseudonymize(frame(spark, rows, clash=True))
    out = sorted(first.collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text for r in out}
    back = N.pseudonymize(first.select("doc_id", "text"), back=True).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((r[0], r[1]) for r in rows), key=str)

    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", texts[1])[0]
    mail = re.search(r"\w\w\.\d\d@mail8\.example\.com", texts[1])[0]
    card = re.search(r"\b\d{16}\b", texts[2])[0]
    assert phone != "+1 (743) 555-3824" and mail != "re.46@mail8.example.com" and card != "4539578763621486" and luhn(card)
    assert phone in texts[5] and mail in texts[5] and card in texts[5]
    assert "not 1234567890123456" in texts[2] and "not 2001-02-30" in texts[3] and "not 000-12-3456" in texts[3]
    assert "300.1.1.1" in texts[4] and "1.2.3.4.5" in texts[4] and "10.0.255.1" not in texts[4]
    spaced = re.search(r"\d{4} \d{4} \d{4} \d{4}", texts[2])[0]
    assert luhn(spaced.replace(" ", ""))
    year, month, day = re.search(r"born (\d{4})-(\d\d)-(\d\d)", texts[3]).groups()
    assert 1900 <= int(year) <= 2100 and 1 <= int(month) <= 12 and 1 <= int(day) <= 31
    counts = {r.doc_id: (r.n_email, r.n_phone, r.n_date, r.n_ssn, r.n_ip, r.n_card) for r in out}
    assert counts[1] == (1, 2, 0, 0, 0, 0) and counts[2] == (0, 0, 0, 0, 0, 2) and counts[3] == (0, 0, 3, 1, 0, 0) and counts[4][4] == 1
    other = {r.doc_id: r.text for r in N.pseudonymize(frame(spark, PRIVATE), key="another").collect()}
    assert other[1] != texts[1]
    assert N.pseudonymize(frame(spark, [])).collect() == []


def test_all_groupings_of_phones_and_cards(spark):
    rows = [(k, text, "en", "s", None) for k, text in enumerate([
        "ring +14155550123.", "ring +33 1 42 68 53 00.", "ring +442079460958 or +44 (0)20 7946 0958.", "ring +1234567 or +1234567890123456",
        "paid 3782 822463 10005.", "paid 6304-9506-0000-0001-005.", "paid 4 5395787 636214 86.", "no. 12 4539 5787 6362 1486 123",
        "paid 4539 5787 6362 1486 3782 822463 10005", "at 5 4539578763621486 1984-02-29 and 7 123-45-6789 10.0.255.1",
        "+1 743 555-3824 12.05.2020", "1 2 3 4 5 6 7 8 9 " * 60])]
    first = N.pseudonymize(frame(spark, rows))
    out = {r.doc_id: r for r in first.collect()}
    shape = lambda text: re.sub(r"\d", "9", text)
    assert [out[k].n_phone for k in range(4)] == [1, 1, 2, 0] and [out[k].n_card for k in range(4, 9)] == [1, 1, 1, 1, 2]
    assert out[0].text.startswith("ring +1") and out[1].text.startswith("ring +33 ") and out[2].text.startswith("ring +44")
    assert all(out[k].text != rows[k][1] and shape(out[k].text) == shape(rows[k][1]) for k in (0, 1, 2, 4, 5, 6, 7, 8))
    assert "4539 5787" not in out[7].text and luhn(re.sub(r"\D", "", out[4].text)) and luhn(re.sub(r"\D", "", out[5].text))
    assert (out[9].n_card, out[9].n_date, out[9].n_ssn, out[9].n_ip) == (1, 1, 1, 1) and (out[10].n_phone, out[10].n_date) == (1, 1)
    back = N.pseudonymize(first.select("doc_id", "text"), back=True).collect()
    assert {r.doc_id: r.text for r in back} == {r[0]: r[1] for r in rows}


def test_numbers_are_permuted(spark):
    from pyspark.sql import functions as F
    got = spark.range(271 * 270).select(N.permute_number(F.col("id"), 271, 270, "date", "k").alias("v")).distinct()
    assert got.count() == 271 * 270
    assert got.agg(F.min("v"), F.max("v")).first() == (0, 271 * 270 - 1)


# --- decontamination


def plain_matches(docs, items):
    """Seeds and counts of equal words, by loops over strings."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for doc_id, text, *_ in docs:
        w = cut(text)
        for item_id, item in items:
            b = cut(item)
            for i in range(len(w) - D.SPAN + 1):
                for j in range(len(b) - D.SPAN + 1):
                    if any(all(w[i + k] == b[j + k] for k in mask) for mask in D.MASKS):
                        low, high = min(i, j, D.REACH), min(len(w) - i, len(b) - j, D.SPAN + D.REACH)
                        same = sum(w[i + k] == b[j + k] for k in range(-low, high))
                        if same >= (-(-len(b) * 8 // 10) if len(b) < D.SHORT_WORDS else D.MIN_EQUAL):
                            out.add((doc_id, item_id))
    return out


@pytest.mark.parametrize("sent", [D.SENT_SEEDS, 0])
def test_decontamination_equals_loops(spark, sent, monkeypatch):
    monkeypatch.setattr(D, "SENT_SEEDS", sent)
    monkeypatch.setattr(D, "SENT_IDS", sent)
    draw = random.Random(8)
    items = [(k, " ".join(f"w{draw.randrange(50)}" for _ in range(n))) for k, n in enumerate((40, 25, 12, 8, 60))] + [(9, None), (10, "")]
    docs = made_docs(15) + ODD[:4]
    for k in range(40):
        words = items[draw.choice([0, 1, 2, 3, 4])][1].split()
        low = draw.randrange(len(words) // 2)
        words = words[low:low + draw.randrange(8, 40)]
        words = [w if draw.random() > 0.12 else "other" for w in words]
        docs.append((100 + k, "Before, it! " + " ".join(w.upper() + draw.choice(["", ",", "***"]) for w in words) + " and after", "en", "s", None))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.seed_matches(frame(spark, docs, clash=True), bench).collect()
    want = plain_matches(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) >= 15
    flags = {r.doc_id: r.contaminated for r in D.decontaminate(frame(spark, docs), bench).collect()}
    assert flags == {d[0]: any(d[0] == w for w, _ in want) for d in docs}


@pytest.mark.parametrize("sent", [D.SENT_SEEDS, 0])
def test_short_items_are_found(spark, sent, monkeypatch):
    monkeypatch.setattr(D, "SENT_SEEDS", sent)
    monkeypatch.setattr(D, "SENT_IDS", sent)
    eleven = [f"e{k}" for k in range(11)]
    items = [(1, "Who wrote the book?"), (2, " ".join(eleven)), (3, "世界上最高的山叫什么名字"), (4, "什么山"), (5, "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10"), (6, None)]
    texts = {
        1: "q: who wrote the BOOK", 2: "who wrote a book", 3: "who wrote the", 10: "x1 x2 x3 x4 x5 x6 x7 x8 x9 x10", 11: "x1 x2 x3 x4 x5 x6 x7 x8 x9 other",
        20: "我想知道世界上最高的山叫什么名字呢", 21: "我不知道什么山好", 22: "我不知道什么好山", 30: "", 31: None}
    want = {1: {1}, 10: {5}, 20: {3}, 21: {4}}
    for k, (a, b) in enumerate([(a, b) for a in range(11) for b in range(a + 1)]):
        texts[100 + k] = " ".join(["before", *("other" if at in (a, b) else w for at, w in enumerate(eleven)), "after"])
        want[100 + k] = {2}
    texts[99] = " ".join("other" if at in (0, 5, 10) else w for at, w in enumerate(eleven))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.seed_matches(frame(spark, [(k, t, "en", "s", None) for k, t in texts.items()]), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d, own in want.items() for i in own}


def test_decontamination_of_rows_without_ids(spark):
    """A row without an id is judged by its own text, whatever other rows without an id say."""
    item = "which of the following rivers flows through the largest number of countries in all of europe today"
    docs = [(None, f"before it {item} after it", "en", "x", None), (None, "a clean text of some words that nobody asks about", "en", "x", None),
            (None, None, "en", "x", None), (3, "another clean text", "en", "x", None)]
    got = D.decontaminate(frame(spark, docs, clash=True), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_items, r.contaminated) for r in got) == [("3", 0, False), ("None", 0, False), ("None", 0, False), ("None", 1, True)]


def test_decontamination_of_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(frame(spark, []), bench).collect() == []
    assert [r.contaminated for r in D.decontaminate(frame(spark, ODD[:1]), bench).collect()] == [False]


# --- line templates


def plain_templates(rows):
    """Texts after dropping, by loops."""
    lines = []
    for doc_id, text, *_ in rows:
        for no, line in enumerate((text or "").split("\n") if text is not None else []):
            words = ["<*>" if re.search(r"[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if len(words) >= T.MIN_WORDS:
                lines.append((doc_id, no, tuple(words)))
    leaves = {}
    for doc_id, no, words in lines:
        leaves.setdefault((len(words), words[:T.LEADING]), []).append((doc_id, no, words))
    template = {}
    for leaf, own in leaves.items():
        if len({w for *_, w in own}) > 1 and len({d for d, *_ in own}) >= T.MIN_DOCS:
            modes = []
            for place in range(leaf[0]):
                count = Counter(w[place] for *_, w in own)
                modes.append(min(count, key=lambda w: (-count[w], w)))
            near = [(d, n) for d, n, w in own if sum(a == b for a, b in zip(w, modes)) / len(modes) >= T.SIMILAR]
            if len({d for d, _ in near}) >= T.MIN_DOCS:
                template.update({x: ("leaf", leaf) for x in near})
    same = {}
    for doc_id, no, words in lines:
        same.setdefault(words, set()).add(doc_id)
    for doc_id, no, words in lines:
        if len(same[words]) >= T.MIN_DOCS:
            template.setdefault((doc_id, no), ("line", words))
    first = {}
    for x, t in template.items():
        first[t] = min(first.get(t, x), x)
    gone = {x for x, t in template.items() if x != first[t]}
    return {(d, None if text is None else "\n".join(line for k, line in enumerate(text.split("\n")) if (d, k) not in gone)) for d, text, *_ in rows}


def shared_lines(seed=3):
    draw = random.Random(seed)
    out = []
    for k in range(40):
        lines = ["my own line number %d with words" % k, " ".join(draw.choice("abcdefgh") for _ in range(9))]
        lines.insert(draw.randrange(3), f"printed on 2020-01-{k % 28 + 1:02d} by user{k} for all")
        if k % 2:
            lines.append("the quick brown fox jumps over the " + draw.choice(["lazy", "lazy", "sleepy"]) + " dog today")
        if k % 3 == 0:
            lines += ["All rights reserved.", "ok"]
        out.append((k, "\n".join(lines), "en", "s", None))
    return out


@pytest.mark.parametrize("sent", [T.SENT_LINES, 0])
@pytest.mark.parametrize("rows", [shared_lines(), shared_lines(4) + [r for r in ODD if r[0] != 1004] + [(r[0] + 3000, *r[1:]) for r in made_docs(30)]])
def test_dropped_lines_equal_loops(spark, rows, sent, monkeypatch):
    monkeypatch.setattr(T, "SENT_LINES", sent)
    docs = frame(spark, rows, clash=True)
    out = T.drop_recurring_lines(docs)
    assert {(r.doc_id, r.text) for r in out.collect()} == plain_templates(rows)
    assert set(docs.columns) <= set(out.columns)
    assert sum(r.n_dropped for r in out.collect()) > 40


def test_leaf_of_several_templates(spark):
    name = lambda k: "n" + "".join("abcdefghij"[int(c)] for c in str(k))
    lines = [f"This page was last edited by {name(k)} today" for k in range(30)]
    lines += [f"This page was first printed in {name(k)} then" for k in range(20)]
    lines += [f"This page was {name(k)} made of paper once" for k in range(8)]
    lines += [f"This page was {name(k)} {name(k)} {name(k)} {name(k)} alone" for k in range(40, 70)]
    # four templates of the same size, so that the leaf's most frequent words are nobody's
    lines += [f"One two three {a} {b} {c} {d} {name(k)}" for k in range(6) for a, b, c, d in ("bxyw", "zcqv", "kmdr", "pstu")]
    out = T.drop_recurring_lines(frame(spark, [(k, line, "en", "s", None) for k, line in enumerate(lines)] + [(40, lines[40], "en", "s", None)])).collect()
    assert {r.doc_id for r in out if r.n_dropped} == {*range(1, 30), *range(31, 50), *range(51, 58), *range(92, 112)}


def plain_rounds(lines):
    """Which of ``(doc_id, line)`` recur, by the definition with all its rounds; all lines are of one leaf, one a document."""
    kinds = {}
    for doc, line in lines:
        kinds.setdefault(tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split()), []).append(doc)

    def near(group, modes):
        return [k for k in group if sum(modes.get(i) == w for i, w in enumerate(k)) / len(k) >= T.SIMILAR]

    def documents(group):
        return len({d for k in group for d in kinds[k]})

    def counts(group, of):
        out = {}
        for k in group:
            for i, w in enumerate(k):
                out[i, w] = out.get((i, w), 0) + of(kinds[k])
        return out

    def modes(seen):
        out = {}
        for (i, w), n in seen.items():
            if i not in out or (-n, w) < out[i]:
                out[i] = (-n, w)
        return {i: w for i, (_, w) in out.items()}

    found = []
    whole = list(kinds)
    if len(whole) > 1 and documents(whole) >= T.MIN_DOCS:
        first = near(whole, modes(counts(whole, len)))
        if documents(first) >= T.MIN_DOCS:
            found.append(first)
    done = {k for g in found for k in g}
    same = [k for k in whole if k not in done and documents([k]) >= T.MIN_DOCS]
    found += [[k] for k in same]
    done.update(same)
    groups = [[k for k in whole if k not in done]] if len(whole) > 1 and sum(len(set(v)) for v in kinds.values()) >= T.MIN_DOCS else []
    while groups:
        group = groups.pop()
        held = counts(group, lambda d: len(set(d)))
        group = [k for k in group if sum(held[i, w] >= T.MIN_DOCS for i, w in enumerate(k) if i >= T.LEADING) + T.LEADING >= T.SIMILAR * len(k) - 1e-9]
        if not group:
            continue
        held, times = counts(group, lambda d: len(set(d))), counts(group, len)
        common = {c: n for c, n in times.items() if held[c] >= T.MIN_DOCS and c[0] >= T.LEADING}
        template = near(group, {**modes(common), **dict(enumerate(group[0][:T.LEADING]))})
        if documents(template) >= T.MIN_DOCS:
            found.append(template)
            groups.append([k for k in group if k not in template])
            continue
        parting = {c: n for c, n in common.items() if n < sum(len(kinds[k]) for k in group)}
        if parting:
            place = max(parting, key=lambda c: (parting[c], -c[0]))[0]
            parts = {}
            for k in group:
                parts.setdefault(k[place] if (place, k[place]) in parting else None, []).append(k)
            groups += parts.values()
    gone = set()
    for template in found:
        docs = sorted(d for k in template for d in kinds[k])
        gone.update(docs[1:])
    return gone


@pytest.mark.parametrize("seed", range(3))
def test_all_rounds_equal_loops(spark, seed):
    draw = random.Random(seed)
    lines = []
    for leaf in range(12):
        shapes = [[draw.choice("abcd") if draw.random() < 0.75 else None for _ in range(draw.choice([3, 6, 9]))] for _ in range(draw.randint(1, 5))]
        width = len(shapes[0])
        for _ in range(draw.randint(4, 60)):
            shape = draw.choice(shapes)[:width]
            shape += [None] * (width - len(shape))
            words = [w or "v" + "".join(draw.choice("abcdefghij") for _ in range(draw.choice([1, 4]))) for w in shape]
            lines.append((leaf, " ".join(["leaf", "number", "x" * (leaf + 1), *words])))
    draw.shuffle(lines)
    rows = [(k, line, "en", "s", None) for k, (_, line) in enumerate(lines)]
    want = set()
    for leaf in range(12):
        want |= plain_rounds([(k, line) for k, (own, line) in enumerate(lines) if own == leaf])
    assert {r.doc_id for r in T.drop_recurring_lines(frame(spark, rows)).collect() if r.n_dropped} == want


def test_lines_of_two_texts_under_one_id(spark):
    """A line that one text of an id loses does not go from the other."""
    rows = [(k, "This very line is in many documents", "en", "s", None) for k in range(8)]
    rows += [(3, "A line that nobody else has at all\nmore", "en", "s", None), (None, "x\nThis very line is in many documents", "en", "s", None), (None, None, "en", "s", None)]
    out = sorted(((r.doc_id, r.text, r.n_dropped) for r in T.drop_recurring_lines(frame(spark, rows)).collect()), key=str)
    assert (3, "A line that nobody else has at all\nmore", 0) in out and (3, "", 1) in out
    assert (None, "x", 1) in out or (0, "", 1) in out
    assert len(out) == len(rows) and sum(n for *_, n in out) == 8


def test_lines_of_odd_tables(spark):
    assert T.drop_recurring_lines(frame(spark, [])).collect() == []
    twice = T.drop_recurring_lines(frame(spark, ODD)).collect()
    assert sorted((r.doc_id, r.text) for r in twice if r.text is not None) == sorted((r[0], r[1]) for r in ODD if r[1] is not None)


# --- secrets


def plain_spans(text):
    text, found = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(x[2] for x in sorted(found))


SECRETS = [
    (1, 'é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ñ AKIAABCDEFGHIJKL23', "en", "s", None),
    (2, "PassWord:hunter22 token: token: abcdefgh12 api_key='short' apikey=AAAABBBB_cc.dd", "en", "s", None),
    (3, "use ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8" + " now", "en", "s", None),
    (4, "a_long_plain_identifier_of_words_2 and http://example.com/some/path/to/the/page-2-of-the-book", "en", "s", None),
    (5, "ſecret=abcdefghij AKIA AKIAAKIA1 0123456789abcdef0123456789abcde", "en", "s", None),
]


def test_base_spans_equal_plain_patterns(spark):
    rows = SECRETS + ODD + [(100 + r[0], *r[1:]) for r in made_docs(10)]
    got = S.scan_secrets(frame(spark, rows, clash=True)).collect()
    plain = sorted((r[0], hashlib.sha256(plain_spans(r[1]).encode()).hexdigest()) for r in rows)
    assert sorted((r.doc_id, r.base_sha256) for r in got) == plain
    spans = {r.doc_id: r.spans for r in got}
    assert spans[1] == plain_spans(SECRETS[0][1]) and "format:4:44" in spans[3] and spans[4] == ""
    assert S.scan_secrets(frame(spark, [])).collect() == []


def test_automata_tell_formats_from_words():
    automata = S.learn(S.made_credentials())
    table = S.background(np.bincount(np.frombuffer(("the quick brown fox jumps over lazy dogs " * 50).encode()[:-1], np.uint8).astype(int) * 256
                                     + np.frombuffer(("the quick brown fox jumps over lazy dogs " * 50).encode()[1:], np.uint8), minlength=65536))
    draw = random.Random(77)
    fresh = ["".join(p if isinstance(p, str) else "".join(draw.choices(p[0], k=p[1])) for p in parts) for parts in S.FORMATS.values() for _ in range(20)]
    hits = sum(S._chances(automata, table, f.encode()) >= S.BITS_PER_CHAR for f in fresh)
    assert hits >= 0.9 * len(fresh)
    github = next(a for a in [S.Automaton(S.made_credentials()["github"])])
    assert github.log2("ghp_" + "a" * 36) > github.log2("xyz_" + "a" * 36)
    assert len(github.next) > 4 and len([s for s in range(len(github.next)) if github.seen[s]]) >= 4


# --- packing


def test_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer
    path = public_tokenizers.path(P.TOKENIZER)
    plain = Tokenizer.from_file(path)
    texts = [r[1] or "" for r in made_docs(30) + ODD] + [
        "a  b", "a \n b", "x\n\n\ny", " lead", "trail ", "tab\tand nbsp  x", "don't we'll I'm 1234 €5", "<|endoftext|> x <|endoftext|>",
        "a <|endoftext|> b", "a  <|endoftext|>\n\nb", "\n<|endoftext|><|endoftext|>x\n<|endoftext|>", "<|endoftext|", "|>", "<|endof", "text|>", "é<|endoftext|>é ",
        "a　b  c", "日本語 テキスト", "🎉 emoji🎉\n🎉", "\n", " ", "\r\n\r\nq", "a\x85b \x85c", "x\x1cy \x1dz", "é\né \né"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, bounds = P.encode_texts(path, data, offsets)
    for k, text in enumerate(texts):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_hold_each_id_once(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public_tokenizers.path(P.TOKENIZER))
    rows = made_docs(60) + [r for r in ODD if r[0] != 1004] + [(2000, "one <|endoftext|> two  <|endoftext|>\n", "en", "x", None)]
    got = P.pack_along_curve(frame(spark, rows, clash=True)).toPandas()
    want = {r[0]: np.array(plain.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows}
    assert set(got.doc_id) == set(want)
    for doc_id, own in got.groupby("doc_id"):
        at = 0
        for r in own.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(want[doc_id]))
            assert r.ids_crc32 == zlib.crc32(want[doc_id][at:at + r.length].tobytes())
            at += r.length
        assert at == len(want[doc_id])
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        total = int(own.length.sum())
        assert total == P.LENGTH or total & (total - 1) == 0 and total < P.LENGTH
    assert P.pack_along_curve(frame(spark, [])).collect() == []


def test_hilbert_keys_walk_to_neighbours():
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = P.hilbert_keys(cells, bits=3)
    assert sorted(keys) == list(range(512))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_like_texts_lie_near_each_other():
    texts = [f"{'stone river bread hand ' * 10}{k}" for k in range(5)] + [f"{'zug über äpfel grün ' * 10}{k}" for k in range(5)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    keys = P.curve_keys(data, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    order = list(np.argsort(keys))
    assert sorted(order[:5]) in ([0, 1, 2, 3, 4], [5, 6, 7, 8, 9])


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- note --><div class="ad">Buy now the best.</div>
<article><h1>A &amp; B</h1><p>First   paragraph of the story, it is long enough to read.</p><p><b>Second&nbsp;one</b> is here.<p>Third one without end.
</article><div class="comments"><h3>Comments</h3><div class="comment"><p>I like it.</p></div></div><footer>&copy; 2020 Site</footer></body></html>"""


def test_main_text_of_a_page():
    (text,) = B.main_texts(B.trained_labeller(), [PAGE])
    assert text == "A & B\n\nFirst paragraph of the story, it is long enough to read.\n\nSecond one is here.\n\nThird one without end."


def test_labeller_on_unseen_layouts():
    draw, labeller, right, every = random.Random(123), B.trained_labeller(), 0, 0
    for _ in range(100):
        page, article = B.made_page(draw)
        blocks = B.leaf_blocks(page)
        chances = labeller.chances(*B.padded([B.features(blocks)]))[0]
        right += sum((p >= 0.5) == (b.text in article) for b, p in zip(blocks, chances))
        every += len(blocks)
    assert right / every >= 0.95


def test_gradients_equal_differences():
    draw = np.random.default_rng(1)
    net = B.Labeller(9)
    x, live = draw.normal(size=(3, 4, B.FEATURES)), np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    y = (draw.random((3, 4)) < 0.5).astype(float)

    def loss():
        p = net.chances(x, live)
        return -(np.where(live, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / live.sum()

    grads = net.gradients(x, live, y)
    for name in net.w:
        for spot in [tuple(draw.integers(0, n) for n in net.w[name].shape) for _ in range(4)]:
            old = net.w[name][spot]
            net.w[name][spot] = old + 1e-5
            high = loss()
            net.w[name][spot] = old - 1e-5
            low = loss()
            net.w[name][spot] = old
            assert abs((high - low) / 2e-5 - grads[name][spot]) < 1e-6


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (3, "u", "   "), (4, "u", "<<<>>> <p"), (5, "u", "<p>unclosed <b>x"), (6, "u", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars", "2 AS key")
    got = B.extract_main_text(pages).collect()
    assert sorted(r.page_id for r in got) == sorted(r[0] for r in rows)
    assert all(r.n_chars == len(r.text) for r in got) and [r.text for r in got if r.page_id == 1] == [""]
    assert B.extract_main_text(pages.limit(0)).collect() == []


# --- pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, FOLDER)
        if name != "packing":
            assert docs.columns == columns and docs.schema == before.schema
            docs = corpus_pipeline.stored(docs, f"test-{name}")
        seen[name] = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}, docs
    quality_in, quality_out = seen["quality"][0], {r.doc_id for r in seen["quality"][1].collect()}
    assert quality_out and all(len(ascii_words(quality_in[d])) >= 50 for d in quality_out)
    lines_in, lines_out = seen["line_dedup"][0], {(r.doc_id, r.text) for r in seen["line_dedup"][1].collect()}
    want = plain_templates([(k, v) for k, v in lines_in.items()])
    assert lines_out == {(d, t) for d, t in want if ascii_words(t) or t == lines_in[d]}
    near_in = [(k, v) for k, v in seen["near_dedup"][0].items()]
    from test_near_duplicates import brute
    near = {k: c for k, (_, c) in brute(near_in).items()}
    assert {r.doc_id for r in seen["near_dedup"][1].collect()} == {k for k in near if near[k] == k}
    items = [(r.item_id, r.text) for r in bench.collect()]
    clean_in = [(k, v) for k, v in seen["decontamination"][0].items()]
    found = {d for d, _ in plain_matches(clean_in[:40], items)}
    kept = {r.doc_id for r in seen["decontamination"][1].collect()}
    assert not kept & found and {d for d, _ in clean_in[:40]} - found <= kept
    packed = {r.doc_id for r in seen["packing"][1].select("doc_id").distinct().collect()}
    assert packed == kept


def test_pipeline_of_odd_documents(spark, tmp_path):
    rows = ODD + made_docs(30)
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "short item")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    frame(spark, []).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0


def test_stages_decide_for_rows_not_ids(spark):
    text = lambda w: " ".join(f"{w}{k}" for k in range(80))
    rows = [(None, text("a"), "en", "x", 1), (None, None, "en", "x", 1), (7, text("b"), "en", "x", 1), (7, text("c"), "en", "x", 1), (8, text("b"), "en", "x", 1),
            (9, text("d"), "en", "x", 1), (9, text("d"), "en", "x", 1), (10, text("item "), "en", "x", 1), (None, text("item "), "en", "y", 1)]
    docs = frame(spark, rows, clash=True)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    texts = sorted(t for _, t in kept if t)
    assert texts == sorted(text(w) for w in ("a", "b", "c", "d", "item ")) and (None, text("a")) in kept and (7, text("c")) in kept
    assert corpus_pipeline.near_dedup(spark, docs, "").columns == docs.columns


def test_decontamination_finds_rows_without_ids(spark, tmp_path):
    item = " ".join(f"word{k}" for k in range(30))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "before " + item, "en", "x", 1), (None, "clean text of its own", "en", "x", 1), (4, item, "en", "x", 1), (4, "another clean text", "en", "x", 1), (5, None, "en", "x", 1)]
    out = corpus_pipeline.decontamination(spark, frame(spark, rows), str(tmp_path)).collect()
    assert sorted(str(r.text) for r in out) == ["None", "another clean text", "clean text of its own"]
