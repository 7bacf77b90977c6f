"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import contextlib
import hashlib
import math
import os
import random
import re
import threading
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe, decontaminate, html_text, langid, ngram_join, pii, ppm, token_counts, toxicity, vector_dedup
from palimpsest.llm.bytewords import ALNUM, NONSPACE, Words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, key string"
SAMPLE = list("ab1.@-+ ()é\n%'s") + ["the ", "ing", " and", "  ", "\n\n", "'re", "世", "😀", "<|endoftext|>", "1.2.3.4", "@x.y", "+1 (555) 123-4567", "4111111111111111"]


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def make_docs(spark, texts):
    """Rows with clashing extra columns; a repeated row, and one with all nulls."""
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), "h", "k") for i, t in enumerate(texts)]
    rows += [rows[0], (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    base = " ".join(rng.choices(words, k=80))
    texts += [base, base.upper(), base + " x", base.replace(base.split()[40], "changed", 1), base]
    near = base.split()
    for k in range(8):
        texts.append(" ".join([*near[: 70 - k], f"w{k}"]))
    texts += ["", None, " \n\t", "one", "one two three", "one two three", "a" * 3000 + " " + "b c " * 2000]
    return texts


TEXTS = corpus()


def empty(spark):
    return spark.createDataFrame([], DOCS)


@given(st.text(max_size=60), st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_words(a, b):
    raw = [a.encode(), b.encode()]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(raw[0]), len(raw[0]) + len(raw[1])]), ALNUM)
    want = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t)) for t in (a, b)]
    got = [[bytes(words.data[s:e]).decode() for s, e in zip(words.start[i:j], words.end[i:j])] for i, j in zip(words.first[:-1], words.first[1:])]
    assert got == want
    hashes = words.hashes()
    assert len(set(hashes.tolist())) == len(set(sum(want, [])))


# --- 1 language
def test_language(spark):
    rng = random.Random(1)
    sets = {"en": ["the", "and", "with", "thing", "house"], "de": ["und", "der", "schön", "haus", "nicht"], "fr": ["le", "été", "avec", "que", "maison"]}
    rows = [(i, " ".join(rng.choices(sets[k], k=12)), k.upper() + "-x" if i % 7 else None, f"www.{k}.example.{k}", None, "h", "k") for i, k in enumerate(rng.choices(list(sets), k=300))]
    truth = {r[0]: r[3].split(".")[1] for r in rows}
    rows += [(900, "und der und der", "fr", "www.de.example.de", None, "h", "k"), (901, "", "en", None, None, "h", "k"), (902, None, None, None, None, "h", "k"), (903, "12 34 !!", "en", "x", None, "h", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r["doc_id"]: r for r in langid.identify(langid.evidence(docs, "text", "lang", "source", "doc_id")).collect()}
    assert all(found[i]["lang_found"] == k and not found[i]["rejected"] for i, k in truth.items())
    assert found[900]["lang_found"] == "de"
    assert all(found[i]["rejected"] and found[i]["lang_found"] == "und" for i in (901, 902, 903))
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["lang"] for r in kept.collect()} == truth | {900: "de"}
    assert langid.keep_known(empty(spark)).count() == 0


def test_host_prior_decides_where_the_text_does_not(spark):
    rows = [(i, "und der haus", "de", "a.example.de", None, "h", "k") for i in range(40)] + [(100 + i, "the and house", "en", "b.example.com", None, "h", "k") for i in range(40)]
    rows += [(500, "abc", None, "a.example.de", None, "h", "k"), (501, "abc", None, "b.example.com", None, "h", "k"), (502, "abc", None, "c.other.de", None, "h", "k"), (503, "abc", None, "d.another.com", None, "h", "k")]
    found = {r["doc_id"]: r["lang_found"] for r in langid.identify(langid.evidence(spark.createDataFrame(rows, DOCS), "text", "lang", "source", "doc_id")).collect()}
    assert (found[500], found[501]) == ("de", "en")
    # hosts without other rows: their suffix decides
    assert (found[502], found[503]) == ("de", "en")


def test_fusion_against_brute_force(spark):
    """Priors, likelihoods and posteriors in plain Python, from the model's scores of texts."""
    rng = random.Random(21)
    sets = {"en": ["the", "and", "with"], "de": ["und", "der", "nicht"], "fr": ["le", "avec", "que"]}
    hosts = ["a.x.com", "b.x.com", "c.y.de", "d.y.de", "e.z.fr", "plain", None, ""]
    rows = []
    for i in range(240):
        k = rng.choice(list(sets))
        text = " ".join(rng.choices(sets[k] if rng.random() < 0.9 else ["abcd", "12"], k=rng.randint(1, 4)))
        rows.append((i, text if i % 40 else None, rng.choice([k, k, "EN-us", None, " "]), rng.choice(hosts), None, "h", "k"))
    facts = langid.evidence(spark.createDataFrame(rows, DOCS), "text", "lang", "source", "doc_id")
    model = langid.train(facts)
    facts = facts.collect()
    raw = [(r["text"] or "").encode() for r in facts]
    scores, count = model.scores(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    names = model.languages
    judged = [(r, int(np.argmax(s))) for r, s, n in zip(facts, scores, count, strict=True) if n]
    table = lambda key: {v: np.array([sum(r[key] == v and j == i for r, j in judged) for i in range(len(names))], float) for v in {r[key] for r, _ in judged} - {None}}
    whole = np.array([sum(j == i for _, j in judged) for i in range(len(names))], float)
    share = lambda x: x / x.sum()
    prior = share(whole + 1)
    declared, suffixes, domains, by_host = table("declared"), table("suffix"), table("domain"), table("host")
    zero = np.zeros(len(names))
    likely = lambda t, v: np.log((t[v] + 0.01) / (whole + 1)) if v in t else zero
    got = {r["doc_id"]: r for r in langid.identify(langid.evidence(spark.createDataFrame(rows, DOCS), "text", "lang", "source", "doc_id")).collect()}
    assert len(got) == len(rows)
    for r, s, n in zip(facts, scores, count, strict=True):
        if not n:
            assert got[r["doc_id"]]["rejected"] and got[r["doc_id"]]["lang_found"] == "und"
            continue
        own = by_host.get(r["host"], zero)
        parent = share(domains[r["domain"]] + langid.WEIGHT * prior) if r["domain"] in domains else prior
        host = share(own + langid.WEIGHT * parent) if r["host"] in by_host else prior
        total = s + likely(declared, r["declared"]) + likely(suffixes, r["suffix"]) * langid.WEIGHT / (own.sum() + langid.WEIGHT) + np.log(host)
        posterior = share(np.exp(total - total.max()))
        assert got[r["doc_id"]]["lang_found"] == names[int(np.argmax(total))]
        assert got[r["doc_id"]]["confidence"] == pytest.approx(posterior.max(), rel=1e-9)


def test_kept_columns_may_have_any_name(spark):
    names = ["high", "host_prior", "fused", "given_declared", "suffix", "domain", "kept_3", "trigrams", "lang_found", "prior_host", "a b"]
    rows = [(i, "der und das haus" if i % 2 else "the house and the", "de" if i % 2 else "en", "a.de", *range(len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` int" for n in names))
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(rows)


def test_rare_languages_are_languages(spark):
    rare = "'on talo ja kissa sekä vihreä metsä'"
    docs = spark.sql(f"select id as doc_id, if(id < 40, {rare}, 'the house and the thing with the cat') as text, if(id < 40, 'fi', 'en') as lang, 's' as source from range(30000)")
    found = langid.identify(langid.evidence(docs, "text", "lang", "source", "doc_id")).filter("doc_id < 40")
    assert {r["lang_found"] for r in found.collect()} == {"fi"}


def test_page_evidence(spark):
    pages = spark.createDataFrame([(1, "https://u@Www.A.example.org:80/x", '<HTML class=x LANG="fr-CA"><script>var a="</p>"</script><p>bonjour</p>')], "page_id int, url string, html string")
    row = langid.page_evidence(pages, "page_id").first()
    assert (row["declared"], row["host"], row["domain"], row["suffix"]) == ("fr", "www.a.example.org", "example.org", "org")
    assert row["text"].split() == ["bonjour"]


# --- 2 personal data
EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum((lambda v: v - 9 if v > 9 else v)(int(x) * (1 + i % 2)) for i, x in enumerate(reversed(digits)))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


@given(st.lists(st.sampled_from(SAMPLE), max_size=30).map("".join))
@settings(max_examples=400, deadline=None)
def test_plain_identifiers(text):
    assert pii.identifiers(text) == plain_spans(text)


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("mail bob [at] mail5 [dot] example [dot] com now", "email", "bob [at] mail5 [dot] example [dot] com"),
        ("to john dot smith at mail dot example dot com please", "email", "john dot smith at mail dot example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ring +1 five five five, one two three four five six seven", "phone", "+1 five five five, one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
        ("host １９２.168.0.1 down", "ip", "１９２.168.0.1"),
        ("a​b@c​.org", "email", "a​b@c​.org"),
    ],
)
def test_disguised_identifiers(text, kind, span):
    assert pii.suspicious(text, any(ord(c) > 0x24F for c in text))
    spans = pii.disguised(text, pii.identifiers(text))
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [(kind, span)]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("to jоhn@example.com now", "email", "jоhn@example.com"),
        ("to john dot smith@gmail.com now", "email", "john dot smith@gmail.com"),
        ("to john@mail.example dot com now", "email", "john@mail.example dot com"),
        ("host 10.0.0.1９ down", "ip", "10.0.0.1９"),
    ],
)
def test_disguised_spans_extend_plain_ones(text, kind, span):
    plain = pii.identifiers(text)
    odd = any(ord(c) > 0x24F for c in text)
    assert plain and pii.suspicious(text, odd)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, plain)] == [(kind, span)]
    assert pii.masked(text, odd) == text.replace(span, f"<{kind.upper()}>")


@pytest.mark.parametrize(
    ("span", "kind"),
    [
        ("192[.]168[.]0[.]1", "ip"),
        ("10 (dot) 0 (dot) 0 (dot) 1", "ip"),
        ("10 dot 0 dot 0 dot 1", "ip"),
        ("one nine two dot one six eight dot zero dot one", "ip"),
        ("192.one six eight.0.1", "ip"),
        ("+1-800-five-five-five-1234", "phone"),
        ("+1 555 one two three 4567", "phone"),
        ("+1 (five five five) one two three 4567", "phone"),
        ("four.one.one.one.one.one.one.one.one.one.one.one.one.one.one.one", "card"),
    ],
)
def test_disguised_numbers(span, kind):
    text = f"so {span} it is"
    plain = pii.identifiers(text)
    assert not plain and pii.suspicious(text, False)
    assert (kind, span) in [(pii.KINDS[k], text[a:b]) for a, k, b in pii.disguised(text, plain)]
    assert pii.masked(text, False) == f"so <{kind.upper()}> it is"


def test_spelled_numbers_that_are_no_identifiers():
    for text in ("10 dot 0 dot 0", "300 dot 1 dot 1 dot 1", "one two three four five six seven", "one. two. three. four.", "phone one or two (2) of 3", "in [.] and (.)"):
        assert not pii.disguised(text, pii.identifiers(text))


DISGUISE = list("ab1.@-+ ()[]") + ["²", "ſ", "ª", "о", "é", "\u00ad", " at ", " dot ", "[at]", "(dot)", "[.]", "me", "site.com", "one ", "two-", "nine", "192.", "1 2 3.4.5.6", "+1 55", "555 010 9999"]


@given(st.lists(st.sampled_from(DISGUISE), max_size=14).map("".join))
@settings(max_examples=1500, deadline=None)
def test_texts_that_are_not_suspicious_hide_nothing(text):
    row = next(pii._texts(pa.record_batch([pa.array([text])], names=["t"]), 0))
    plain = pii.identifiers(text)
    if not pii.suspicious(text, row[3][0]):
        assert pii.disguised(text, plain) == []


def test_characters_that_are_rewritten_are_odd():
    for c in map(chr, range(0x80, 0x3000)):
        row = next(pii._texts(pa.record_batch([pa.array(["a" + c + "b"])], names=["t"]), 0))
        if pii.Tape.of(c).characters().text != c:
            assert row[3] == [True]
    phone = "+1 55²³ 010 9999"
    assert [(k, phone[a:b]) for a, k, b in pii.disguised(phone, [])] == [(3, phone)]
    assert next(pii._texts(pa.record_batch([pa.array([phone, "café naïve"])], names=["t"]), 0))[3] == [True, False]


def test_clean_texts_have_no_spans():
    for text in ("meet me at site.com today", "look at example.org now", "we met at the shop. dot your is", "one two three", "at noon [at] (dot)", "version 1.2.3", "seven of nine"):
        assert not pii.disguised(text, pii.identifiers(text))


def test_pii_query_and_mask(spark):
    texts = ["x a@b.com 1.2.3.4", "", None, "bob [at] c [dot] org", "+1 (555) 123-4567" * 50, "4111111111111111"]
    docs = make_docs(spark, texts)
    rows = pii.find(docs, digests=True).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else "") or ""
        plain = plain_spans(text)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for _, k, _ in plain) for kind in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in plain).encode()).hexdigest()
    masked = pii.mask(docs)
    assert masked.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert got[0] == "x <EMAIL> <IP>" and got[1] == "" and got[2] is None and got[3] == "<EMAIL>" and got[5] == "<CARD>"
    assert pii.find(empty(spark)).count() == 0


# --- 3 byte-level BPE
def test_bpe_round_trip(spark):
    import tiktoken

    ranks, pattern = bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choices(SAMPLE, k=rng.randint(0, 40))) for _ in range(80)] + ["-" * 900, "ab" * 400]
    rows = bpe.encode(make_docs(spark, texts), ranks, pattern).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else "") or ""
        assert r["ids"] == library.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode()
        assert r["n_tokens"] == len(r["ids"])
    digest = {r["doc_id"]: r for r in bpe.encode(make_docs(spark, texts), ranks, pattern, digests=True).collect()}
    ids = library.encode_ordinary(texts[5])
    assert digest[5]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert digest[5]["decoded_sha256"] == hashlib.sha256(texts[5].encode()).hexdigest()
    assert bpe.encode(empty(spark), ranks, pattern).count() == 0


def test_bpe_of_long_pieces():
    import tiktoken

    ranks, pattern = bpe.public_ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    coder = bpe.Coder(ranks, bpe.merge_table(ranks), pattern)
    rng = random.Random(3)
    texts = ["".join(rng.choices(letters, k=k)) for letters, k in (("etaoinshrdlu", 200_000), ("ACGT", 30_000), ("กขคงจฉชซ", 9_000), ("-=", 4_000), ("é", 700))]
    texts += ["-" * 777 + "#" * 4_000 + "=-" * 2_000, "x" * 3 + "-" * 9_000, " " * 3_000 + "x", "ab" * 65, "q" * 64, "q" * 65, ""]
    raw = [t.encode() for t in texts]
    began = time.perf_counter()
    coded = coder.encode(texts, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert time.perf_counter() - began < 60
    for text, (n, ids, decoded) in zip(texts, coded, strict=True):
        want = library.encode_ordinary(text)
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), text.encode())


# --- 4 decontamination
def brute_contamination(texts, items, width=10):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for i, t in items:
        w = word.findall(lower(t))
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add("" if i is None else str(i))
    lengths = {len(w) for w in windows}
    out = []
    for t in texts:
        w, hit, found = word.findall(lower(t)), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if items_ := windows.get(tuple(w[k : k + n])):
                    found |= items_
                    hit |= set(range(k, k + n))
        out.append((len(w), len(hit), sorted(found)))
    return out


def brute_match(text, items, width=10):
    """The longest verbatim match that has a window: words, place in the text, item, place in the item."""
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    w, best = word.findall(lower(text)), None
    for i, t in items:
        v = word.findall(lower(t))
        for p in range(len(w)):
            for o in range(len(v)):
                n = 0
                while p + n < len(w) and o + n < len(v) and w[p + n] == v[o + n]:
                    n += 1
                if n >= min(width, len(v)):
                    found = (-n, p, i is not None, i, o)
                    best = found if best is None or found[:3] < best[:3] or (found[:3] == best[:3] and found[2] and found[3:] < best[3:]) or (found[:4] == best[:4] and o < best[4]) else best
    return (-best[0], best[1], best[3], best[4]) if best else (0, None, None, None)


@pytest.mark.parametrize("limit", [decontaminate.PIECE_BYTES, 300])
def test_decontamination(spark, limit):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice((0, 2, 5, 14, 20))))) for k in range(12)] + [(20, None), (None, "w1 w2 w3 w4"), (3, "w5 w6 w7")]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 80))) for _ in range(40)]
    texts += [f"x {items[k][1]} y {items[k][1].upper()}" for k in range(12)] + ["", None]
    benchmark = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, key string")
    docs = make_docs(spark, texts)
    rows = decontaminate.contamination(docs, benchmark, limit=limit).collect()
    want = brute_contamination(texts, items)
    assert len(rows) == len(texts) + 2
    for r in rows:
        n, hit, found = want[r["doc_id"]] if r["doc_id"] is not None else (0, 0, [])
        text = texts[r["doc_id"]] if r["doc_id"] is not None else None
        assert (r["match_words"], r["match_at"], r["match_item"], r["match_offset"]) == brute_match(text, items)
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    kept = decontaminate.clean(docs, benchmark, limit=limit)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted([i for i, w in enumerate(want) if not w[1]] + ([0] if not want[0][1] else []))


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "q a b c d e z a b c"), (2, "a b c d e f g"), (3, "z")], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, "a b c d e f h i j k l m")], "item_id bigint, text string")
    found = {r["offset"]: (r["words"], r["doc_id"], r["at_word"]) for r in decontaminate.longest_matches(docs, benchmark).collect()}
    assert found[0] == (6, 2, 0) and found[1] == (5, 2, 1) and found[2] == (4, 2, 2)
    assert decontaminate.contamination(docs, benchmark.filter("false")).filter("contaminated").count() == 0


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s = rng.integers(0, 3, rng.integers(0, 40))
        assert decontaminate.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


# --- 5 vectors
def brute_links(vectors, labels, threshold=0.98):
    n, links, parent = len(vectors), Counter(), list(range(len(vectors)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            a, b = vectors[i], vectors[j]
            if labels[i] is None or labels[i] != labels[j] or a is None or b is None or len(a) != len(b) or None in a or None in b:
                continue
            x, y = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return links, [find(i) for i in range(n)]


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "SHARD", 60)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(60, 16))
    rows = [(centres[rng.integers(60)] + rng.normal(size=16) * rng.choice([0.02, 0.06, 0.5])).tolist() for _ in range(420)]
    rows += [rows[0], rows[0], [x * 2 for x in rows[0]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0, 2.0], [1.0, 2.0], []]
    labels = [int(rng.integers(2)) for _ in rows]
    labels[-12] = labels[-11] = labels[0]
    labels[5] = None
    embeddings = spark.createDataFrame(list(zip(range(len(rows)), rows, labels)), "vec_id bigint, embedding array<float>, label int")
    result = vector_dedup.near_duplicates(embeddings)
    links, roots = brute_links(rows, labels)
    got = {r["vec_id"]: r for r in result.collect()}
    assert len(got) == len(rows)
    assert sum(got[i]["n_links"] for i in got) >= 0.9 * sum(links.values())
    assert all(got[i]["n_links"] <= links[i] for i in got)
    exact = sum(got[i]["n_links"] == links[i] and got[i]["component_id"] == roots[i] for i in got)
    assert exact >= 0.9 * len(rows)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert vector_dedup.near_duplicates(embeddings.filter("false")).count() == 0


def test_vectors_of_large_groups(spark):
    """More different near copies in a group than a node has candidates, some of them in tight parts."""
    rng = np.random.default_rng(1)
    around = lambda c, m, s: c + rng.normal(size=(m, 64)) * s * np.linalg.norm(c) / 8
    every, labels = [], []
    for label in range(2):
        wide = [around(rng.normal(size=64), 200, 0.1) for _ in range(3)]
        parts = [around(x, 100, 0.01) for _ in range(2) for x in around(rng.normal(size=64), 3, 0.13)]
        rows = np.concatenate([rng.normal(size=(150, 64)), *wide, *parts]).astype(np.float32)
        every += rows.tolist()
        labels += [label] * len(rows)
    v = np.array(every, np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    links = ((v @ v.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels))).sum(1) - 1
    embeddings = spark.createDataFrame(list(zip(range(len(every)), every, labels)), "vec_id bigint, embedding array<float>, label int")
    result = vector_dedup.near_duplicates(embeddings)
    got = {r["vec_id"]: r["n_links"] for r in result.collect()}
    assert links.max() > 3 * vector_dedup.EFFORTS[0][0]
    assert sum(got.values()) >= 0.999 * links.sum()
    assert all(got[i] <= n for i, n in enumerate(links))


@pytest.mark.parametrize(("shard", "part"), [(1_500, 6_000), (100, 150)])
def test_vectors_in_blobs(spark, monkeypatch, shard, part):
    """Blobs of near copies, a label each, with one shard and with several dealt-out ones."""
    monkeypatch.setattr(vector_dedup, "SHARD", shard)
    monkeypatch.setattr(vector_dedup, "PART", part)
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for label, (blobs, size, noise) in enumerate([(2, 200, 0.1), (5, 100, 0.1), (10, 100, 0.05), (3, 400, 0.1), (20, 40, 0.1), (20, 40, 0.2)]):
        for c in rng.normal(size=(blobs, 64)):
            rows.append(c + rng.normal(size=(size, 64)) * noise * np.linalg.norm(c) / 8)
            labels += [label] * size
    v = np.concatenate(rows)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    linked = (u @ u.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels))
    links = linked.sum(1) - 1
    embeddings = spark.createDataFrame(list(zip(range(len(v)), v.tolist(), labels)), "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(embeddings).collect()}
    assert sum(got[i]["n_links"] for i in got) >= 0.99 * links.sum()
    assert all(got[i]["n_links"] <= n for i, n in enumerate(links))
    low = np.arange(len(v))
    while ((new := np.where(linked, low[None, :], len(v)).min(1)) != low).any():
        low = new
    assert sum(got[i]["component_id"] == r for i, r in enumerate(low.tolist())) >= 0.99 * len(v)


@pytest.mark.parametrize("part", [6_000, 150])
def test_vectors_of_many_cells_take_little_disk(spark, monkeypatch, part):
    """Unstructured vectors with some near copies: what is on disk at once follows the input, not the cells that a vector is near to."""
    monkeypatch.setattr(vector_dedup, "SHARD", 50)
    monkeypatch.setattr(vector_dedup, "PART", part)
    monkeypatch.setattr(vector_dedup, "LEAST_ROUND", 1, raising=False)
    monkeypatch.setattr(vector_dedup, "WHOLE", 1, raising=False)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4_000, 64))
    v[2_000:3_000] = v[:1_000] + rng.normal(size=(1_000, 64)) * 0.13
    v = v.astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.98).sum(1) - 1
    embeddings = vector_dedup.stored(spark.createDataFrame(list(zip(range(len(v)), v.tolist(), [1] * len(v))), "vec_id bigint, embedding array<float>, label int"))
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()] + [spark.conf.get("spark.checkpoint.dir").removeprefix("file://")]
    start, peak, done = time.time(), 0, threading.Event()

    def watch():
        nonlocal peak
        while not done.wait(0.02):
            now = 0
            for top in folders:
                for folder, _, names in os.walk(top):
                    for name in names:
                        with contextlib.suppress(FileNotFoundError):
                            at = os.stat(os.path.join(folder, name))
                            now += at.st_size * (at.st_mtime >= start)
            peak = max(peak, now)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(embeddings).collect()}
    finally:
        done.set()
        watcher.join()
    assert links.sum() > 1_500
    assert sum(got.values()) >= 0.99 * links.sum()
    assert all(got[i] <= n for i, n in enumerate(links))
    assert peak < 8 * v.nbytes


def test_vectors_are_compared_in_double_precision(spark):
    a = np.array([1.0, 0.0])
    b = np.array([0.98, math.sqrt(1 - 0.98**2) * (1 + 1e-10)])
    rows = [(0, a.tolist(), 1), (1, b.tolist(), 1), (2, a.tolist(), 2), (3, [0.98, math.sqrt(1 - 0.98**2) * (1 - 1e-10)], 2)]
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_vectors_that_are_not_found_raise(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "_audited", lambda *_: 0.5)
    embeddings = spark.createDataFrame([(1, [1.0, 2.0], 1)], "vec_id bigint, embedding array<float>, label int")
    with pytest.raises(RuntimeError, match="0.500"):
        vector_dedup.near_duplicates(embeddings)


# --- 6 n-gram join
def brute_classes(texts, ids, threshold=0.8, n=5):
    sets = []
    for t in texts:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    links, parent = Counter(), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return links, [ids[find(i)] for i in range(len(texts))]


@pytest.mark.parametrize(("block", "chain"), [(64, 1.0), (3, 1e9), (3, 0.0)])
def test_ngram_join(spark, monkeypatch, block, chain):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "CHAIN", chain)  # components, or buckets
    docs = make_docs(spark, TEXTS)
    links, roots = brute_classes(TEXTS, list(range(len(TEXTS))))
    twice = {0, *[i for i, r in enumerate(roots) if r == roots[0] and i != 0]}
    got = ngram_join.jaccard_classes(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r["doc_id"] is None:
            assert (r["class_id"], r["n_links"]) == (None, 0)
        else:
            assert r["class_id"] == roots[r["doc_id"]]
            assert r["n_links"] == links[r["doc_id"]] + (r["doc_id"] in twice)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(roots))


def test_ngram_join_of_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    docs = spark.createDataFrame([(5, a), (5, b), (5, b), (3, b + " x"), (9, a)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.jaccard_classes(docs).collect())
    assert got == [(3, 3, 2), (5, 3, 2), (5, 3, 2), (5, 5, 1), (9, 5, 1)]
    assert sorted((r[0], r[1][0]) for r in ngram_join.one_of_each(docs).collect()) == [(3, "b"), (5, "a")]


def test_banding_reaches_its_recall():
    for threshold, recall in ((0.8, 0.999), (0.5, 0.9), (0.9, 0.99)):
        bands, rows = ngram_join.banding(threshold, recall)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= 128


def test_ngram_join_of_nothing(spark):
    assert ngram_join.jaccard_classes(empty(spark)).count() == 0


# --- 7 language model
def reference_log10(texts, train, query, order):
    """Prediction by partial matching, symbol by symbol, with dictionaries."""
    counts = defaultdict(Counter)
    sequence = lambda t: b" ".join(re.findall(rb"[^\x20\x09-\x0d]+", lower(t).encode())) + b"\xff"
    for t in train:
        s = b"\xff" * order + sequence(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    s, total = b"\xff" * order + sequence(query), 0.0
    for i in range(order, len(s)):
        shut: set = set()
        for k in range(order, -1, -1):
            seen = {c: n for c, n in counts[s[i - k : i]].items() if c not in shut}
            mass = sum(seen.values())
            if s[i] in seen:
                total += math.log10((seen[s[i]] - ppm.DISCOUNT) / mass)
                break
            if seen:
                total += math.log10(ppm.DISCOUNT * len(seen) / mass)
            shut |= set(counts[s[i - k : i]])
        else:
            total -= math.log10(257 - len(shut))
    return total


@pytest.mark.parametrize("bucket", [ppm.BUCKET_GRAMS, 300])
def test_ppm(spark, monkeypatch, bucket):
    monkeypatch.setattr(ppm, "BUCKET_GRAMS", bucket)
    monkeypatch.setattr(ppm, "SLICE_NAMES", bucket)
    texts = [t for t in TEXTS if len(t or "") < 1000]
    docs = make_docs(spark, texts)
    rows = ppm.scores(docs).collect()
    ids = [*range(len(texts)), 0, None]
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i in ids}
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", lower(texts[i] if i is not None else "")), "\0"] for i in ids}
    c = Counter(t for i in ids if not held[i] for t in tokens[i])
    n = sum(c.values())
    train = [texts[i] if i is not None else "" for i in ids if not held[i]]
    assert len(rows) == len(ids)
    for r in rows:
        own = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(own), sum(t in c for t in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + len(c) + 1)) for t in own), abs=1e-9)
    for r in rows[:12]:
        query = texts[r["doc_id"]] if r["doc_id"] is not None else ""
        assert r["score"] == pytest.approx(reference_log10(texts, train, query, ppm.ORDER), rel=1e-4, abs=1e-4)
    assert ppm.scores(empty(spark)).count() == 0


def test_grams_in_pieces(monkeypatch):
    texts = ["", "ab c", "x" * 50, " ", "é é\u00a0é", "the end " * 9]
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]), NONSPACE)
    want = Counter()
    for i, t in enumerate(texts):
        s = b"\xff" * ppm.ORDER + b" ".join(re.findall(rb"[^\x20\x09-\x0d]+", t.encode())) + b"\xff"
        want.update((s[k : k + ppm.ORDER + 1], i) for k in range(len(s) - ppm.ORDER))
    for piece in (1, 7, 64, ppm.PIECE):
        monkeypatch.setattr(ppm, "PIECE", piece)
        got = Counter()
        for packed, times in ppm.grams(*ppm.stream(words)):
            for p, n in zip(packed.tolist(), times.tolist()):
                got[(p >> 16).to_bytes(ppm.ORDER + 1, "big"), p & 0xFFFF] += n
        assert got == want


def test_ppm_probabilities_sum_to_one():
    rng = np.random.default_rng(5)
    key = np.unique(rng.integers(0, 1 << 24, 300).astype(np.uint64) & np.uint64(0x030303))
    n = rng.integers(1, 9, len(key))
    levels = [(key, n)]
    for k in (1, 0):
        short, inverse = np.unique(levels[0][0] & np.uint64((1 << (8 * (k + 1))) - 1), return_inverse=True)
        levels.insert(0, (short, np.bincount(inverse, levels[0][1]).astype(np.int64)))
    trie = ppm.Trie(levels)
    for context in (0x0000, 0x0102, 0x0905, 0x0302):
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        # one of the 257 symbols has no byte
        total = (10 ** trie.log10(every)).sum()
        assert 0.9 < total <= 1 + 1e-6


# --- 8 pages
def page(main, host=1, extra=""):
    return f'<html lang=en><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href=/>home</a></ul></nav><header>Site {host}</header><div class="ad">buy</div>{extra}{main}<footer>&copy; x</footer></body></html>'


def test_pages(spark):
    cases = [
        (page("<article><h1>A &amp; B</h1><p><b>one<br><p>two  <i>t</i>hree</p><section class='comments'><p>nice</p></section></article>"), "A & B one two three"),
        (page("<article><p>x</p><aside>side</aside><form>f</form><script>var t='</p>';</script><!-- no -->y"), "x y"),
        (page("<main><p>m&nbsp;n &#233;</p></main>"), "m n é"),
        ("<p>loose<div>text</div>more < 3", "loose text more < 3"),
        ("<div hidden>a</div><div style='display:none'>b</div><p>yes", "a b yes"),
        ('<article><p>a</p><p class="comment">b</p><div class="social">study of ants</div><p id="notice">c</p></article>', "a b study of ants c"),
        ('<article><p>a</p><article class=x><p>reader</p></article><div id="comments">x</div></article><article><p>b</p></article>', "a"),
        ('<div class="site_header">h</div><p class="menu">a</p><div class="menuetto">b</div><div role="navigation">n</div><search>s</search>c', "a b c"),
        ("<head><title>t</title><body><table><tr><td>1<td>2<tr><td>3</table><button>no</button><ul><li>x<li>y", "1 2 3 x y"),
        ("</p></div></table><td>a</article>b<p><p>c</b></p>", "ab c"),
        ('<div title="a>b" class=x>in</div>', "in"),
        ("", ""),
        (None, ""),
    ]
    pages = spark.createDataFrame([(i, f"http://h{i}.org/", h, 1) for i, (h, _) in enumerate(cases)], "page_id bigint, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.main_text(pages).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i]["text"] == want
        assert got[i]["n_chars"] == len(want)
    assert html_text.main_text(pages.filter("false")).count() == 0


def test_site_templates_go_and_copies_stay(spark):
    rows = [(k, "http://a.org/x", f"<body><div class=box><p>Follow our team on all channels</p></div><p>Story {k} {'word ' * (30 + k)}</p></body>") for k in range(10)]
    rows += [(100 + k, "http://b.org/x", "<body><div><p>The same short story, copied</p></div></body>") for k in range(10)]
    rows += [(200, "http://c.org/x", "<body><div class=box><p>Follow our team on all channels</p></div><p>Other site with words and words and words</p></body>"), (201, None, "<p>no host</p>")]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k].startswith(f"Story {k} ") and "Follow" not in got[k] for k in range(10))
    assert all(got[100 + k] == "The same short story, copied" for k in range(10))
    assert "Follow" in got[200] and got[201] == "no host"


def test_templates_of_a_section_go_on_a_large_host_and_thin_pages_count(spark):
    box = "<div class=box><p>Follow our team on all channels</p></div>"
    rows = [(k, "http://a.org/x", f"<body>{box if k < 5 else ''}<p>Story {k} {'word ' * (30 + k)}</p></body>") for k in range(600)]
    rows += [(1000 + k, "http://b.org/x", f"<body>{box}<p>Story {k} {'word ' * (30 if k < 3 else 0)}</p></body>") for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(got[k].startswith(f"Story {k} ") and "Follow" not in got[k] for k in range(600))
    assert all(got[1000 + k].startswith(f"Story {k} ") for k in range(3))


def brute_pages(pages, least):
    """Texts and deleted subtrees of pages given as (host, tree); a tree is (tag, children), a child a tree or a line."""
    lines = lambda t: [t] if isinstance(t, str) else sum(map(lines, t[1]), [])
    below = lambda t: [] if isinstance(t, str) else [t, *sum(map(below, t[1]), [])]
    where = defaultdict(set)
    for host, tree in pages:
        for t in below(tree):
            if lines(t):
                where[host, repr(t)].add(tuple(lines(tree)))
    out = []
    for host, tree in pages:
        total, count = sum(map(len, lines(tree))), 0

        def cut(t):
            nonlocal count
            if isinstance(t, str):
                return [t]
            if lines(t) and len(where[host, repr(t)]) >= least and sum(map(len, lines(t))) * 2 < total:
                count += 1
                return []
            return sum(map(cut, t[1]), [])

        out.append((" ".join(cut(tree)), count))
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(12)
    words = [f"word{k}" for k in range(9)]

    def tree(depth):
        tag = rng.choice(["div", "section", "ul", "table"] if depth else ["p", "li", "td"])
        children = [tree(rng.randint(0, depth - 1)) if depth and rng.random() < 0.8 else " ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 4) if depth else 1)]
        return (tag, tuple(children)) if tag not in ("ul", "table", "li", "td") else ("div" if depth else "p", tuple(children))

    shared = [tree(2) for _ in range(12)]
    pages = [(f"h{rng.randint(0, 2)}", ("div", tuple(rng.sample(shared, 4) + [tree(3) for _ in range(3)]))) for _ in range(120)]
    pages += [pages[0], pages[0], pages[0]]
    # a line after a line would be one block
    render = lambda t: t + "<br>" if isinstance(t, str) else f"<{t[0]}>{''.join(map(render, t[1]))}</{t[0]}>"
    rows = [(i, f"http://{host}/x", f"<body>{render(t)}</body>") for i, (host, t) in enumerate(pages)]
    got = {r["page_id"]: (r["text"], r["n_removed"]) for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = brute_pages(pages, html_text.LEAST_PAGES)
    assert sum(n for _, n in want) > 100
    assert [got[i] for i in range(len(pages))] == want


def test_deep_pages_take_linear_time():
    began = time.perf_counter()
    deep = html_text.Page("<div>x</b>" * 50_000)
    assert len(deep.blocks) == 50_000 and deep.blocks[0] == "x" and time.perf_counter() - began < 20
    assert html_text.without(*html_text.unpacked(deep.packed()), set(range(50_000)))[1] == 1


def test_templates_of_a_hot_host_and_odd_rows(spark):
    nav = "<nav><ul><li><a href=/>home</a><li>news</ul></nav>"
    rows = [(k % 50, "http://hot.org/x", f"{nav}<article><h1>Same title</h1><p>Story {k} {'word ' * 9}</p></article>") for k in range(400)]
    rows += [(None, None, None), (None, "http://hot.org", nav)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "page_id bigint, url string, html string, gone string, blocks int, row_id int")
    got = html_text.main_text(docs).collect()
    assert len(got) == 402
    stories = [r for r in got if r["page_id"] is not None]
    assert all(r["text"].startswith("Same title Story") and r["n_removed"] == 1 for r in stories)
    assert sorted(r["text"] for r in got if r["page_id"] is None) == ["", ""]


# --- 9 toxicity
def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(200)]
    bad = ["idiot", "scum", "moron", "trash"]
    rows, labels = [], []
    for i in range(1600):
        toxic = i % 10 == 0
        text = rng.choices(words, k=rng.randint(5, 60)) + (rng.sample(bad, 2) if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), None, None, None, "h", "k"))
        if zlib.crc32(f"x{i}".encode()) % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(5000, "", None, None, None, "h", "k"), (5001, None, None, None, None, "h", "k"), (None, "idiot scum", None, None, None, "h", "k")]
    docs = spark.createDataFrame(rows, DOCS)
    table = spark.createDataFrame(labels + [(7, 0, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = toxicity.scores(docs, toxicity.train(docs, table)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1600 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held)
    right = sum((r["doc_id"] % 10 == 0) == bool(r["predicted"]) for r in held)
    assert right >= 0.97 * len(held)
    none = toxicity.scores(docs, toxicity.train(docs, table.filter("toxic = 0")))
    assert none.filter("score <> 0").count() == 0
    assert toxicity.scores(empty(spark), toxicity.train(empty(spark), table)).count() == 0


def test_risk_is_not_negative():
    p = [np.array([1, 2], np.uint64)] * 5
    u = [np.array([3], np.uint64)] * 20 + [np.array([1, 2], np.uint64)] * 3
    model = toxicity.fit(p, u, 0.2)
    assert model.intercept is not None and np.isfinite(model.weights).all()


# --- 10 token counts
def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    with open(path, "rb") as file:
        raw = file.read()
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rng = random.Random(8)
    odd = ["".join(rng.choices(SAMPLE, k=rng.randint(0, 25))) for _ in range(60)]
    texts = TEXTS + odd
    rows = token_counts.prefix_counts(make_docs(spark, texts), raw, public_tokenizers.PATTERN, limit=20).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = (texts[r["doc_id"]] if r["doc_id"] is not None else "") or ""
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), count(text), count(text) > 20)
        if text in odd:
            counts = [count(text[:i]) for i in range(len(text) + 1)]
            assert [token_counts.tokens_at(r["changes"], i) for i in range(len(text) + 1)] == counts
            assert token_counts.longest_prefix(r["changes"], 9) == max(i for i, n in enumerate(counts) if n <= 9)
            assert r["fitting_chars"] == max(i for i, n in enumerate(counts) if n <= 20)
    assert token_counts.prefix_counts(empty(spark), raw, public_tokenizers.PATTERN).count() == 0


def test_word_class_of_the_model():
    words = Words(np.frombuffer("Ab  c\n\né.".encode(), np.uint8), np.array([0, 10]), NONSPACE)
    assert [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)] == ["ab", "c", "é."]
