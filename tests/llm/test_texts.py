"""Repeated bytes, contamination, secrets, pseudonyms and line chunks against brute force, and on odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F
from tallyspark.llm import contamination, lines, pseudonyms, repeats, secrets

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def pairs(documents):
    return [tuple(r) for r in documents.select("doc_id", "text").collect()]


# repeated bytes


def found_repeats(df, **more):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in repeats.without_repeats(df, **more).collect()}


def test_repeats_match_brute_force(documents, pairs):
    assert found_repeats(documents) == brute.repeated_bytes(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_a_small_alphabet(spark, monkeypatch, seed):
    """Periods, overlaps and self-repeats are frequent here, and batches hold a few texts each."""
    monkeypatch.setattr(repeats, "SLICE_BYTES", 700)
    rng = random.Random(seed)
    docs = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 200)))) for i in range(40)] + [(40, "ab" * 90), (41, "ba" * 70), (42, "a" * 300), (43, "a" * 90)]
    rng.shuffle(docs)
    got = found_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), length=16, q=6, part_bytes=500)
    assert got == brute.repeated_bytes(docs, 16)


def test_refined_buckets_are_equal_strings():
    import numpy as np

    rng = np.random.default_rng(0)
    text = rng.integers(0, 2, (50, 60)).astype(np.uint8)
    for length in (5, 9, 16, 30):
        ranks = repeats.refined(text, length)
        seen = {}
        for i in range(ranks.shape[0]):
            for j in range(60 - length + 1):
                assert seen.setdefault(int(ranks[i, j]), text[i, j : j + length].tobytes()) == text[i, j : j + length].tobytes()
        assert len(set(seen.values())) == len(seen)


def test_repeats_of_odd_rows(odd, nothing):
    rows = repeats.without_repeats(odd).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[1].kept == b"" and got[0].removed == [] and got[8].kept.endswith(b" end"[-3:]) and len(got[8].kept) < 50
    assert got[9].removed == [] and got[2].n_bytes == got[3].n_bytes == 0
    assert all(r.removed == [] for r in rows if r.doc_id in (12, None))
    assert repeats.without_repeats(nothing).count() == 0


# contamination


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_contamination_matches_brute_force(spark, documents, pairs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.contamination(pairs, [tuple(r) for r in bench.select("item_id", "text").collect()])
    for most in (contamination.MAX_WINDOWS, 300):  # one block, and several
        got = {r.doc_id: (r.n_words, len(r.hit_words), r["items"]) for r in contamination.contamination(documents, bench, max_windows=most).collect()}
        assert got == want


def test_contamination_of_odd_rows(spark, odd, nothing):
    bench = items_of(spark, [(1, "the quick BROWN fox jumps over the lazy dog while seven"), (2, "ONE, two!"), (3, ""), (4, None), (5, "Köln 東京"), (6, "one two"), (None, "word1 part1")])
    for most in (1000, 3):
        rows = contamination.contamination(odd, bench, max_windows=most).collect()
        got = {r.doc_id: r for r in rows if r.doc_id is not None}
        assert len(rows) == odd.count()
        assert len(got[0].hit_words) == 11 and got[0]["items"] == ["1"] and got[0].hit_words == list(range(11))
        assert got[5]["items"] == got[6]["items"] == ["2", "6"] and got[2].n_words == got[3].n_words == 0
        assert got[11]["items"] == ["1", "5"] and len(got[11].hit_words) == 13
        assert len(got[7].hit_words) > 0 and got[7]["items"] == []
        kept = contamination.without_contaminated(odd, bench, max_windows=most)
        assert kept.schema == odd.schema and sorted({r.doc_id for r in kept.collect() if r.doc_id is not None}) == [2, 3, 4, 9, 12, 13]
    assert contamination.contamination(nothing, bench).count() == 0
    assert not any(r.hit_words for r in contamination.contamination(odd, bench.limit(0)).collect())


# secrets


def test_base_spans_match_brute_force(documents, pairs):
    got = {r.doc_id: r.spans for r in secrets.secrets(documents).collect()}
    for d, text in pairs:
        want = brute.base_spans(text)
        assert [(s.start, s.kind, secrets.KINDS[s.kind], s.end) for s in got[d] if s.kind < 3] == want


def test_span_rules():
    kinds = lambda t: [(secrets.KINDS[k], t[s:e]) for s, e, k, _ in secrets.scan(t)]
    assert kinds('Api_Key: "abcDEF123456"') == [("assign", 'Api_Key: "abcDEF123456')]
    assert kinds("password: token: abcdefghijklmnop") == []  # the short match before takes the keyword
    assert kinds("password: short token=longenough12") == [("assign", "token=longenough12")]
    assert kinds("Key toKen=abcdefghijklmnop") == []  # letters beyond ASCII are no case variants
    assert kinds("AKIAABCDEFGHIJKLMN AKIASHORT") == [("access", "AKIAABCDEFGHIJKLMN")]
    assert kinds("é 0123456789abcdef.") == [("hex", "0123456789abcdef")]


def test_ownership_separates_copies_from_live_values(spark):
    live, copied = "Zx9Kq2Lm4Np6Rt8Vw1Yb3Dc5Fg7", "Qw3Er5Ty7Ui9Op1As3Df5Gh7Jk9"
    rows = [(i, f"repo{i}", f"owner{i % 7}", f"see {copied} here") for i in range(21)] + [(50, "repo1", "owner1", f"x {live} and again {live}"), (51, "repo1", "owner1", live)]
    df = spark.createDataFrame(rows, "doc_id long, repo string, owner string, text string")
    got = {r.doc_id: r.spans for r in secrets.secrets(df, "owner", "repo").collect()}
    assert all(got[i] == [] for i in range(21))
    assert [(s.start, s.end, s.kind, s.owners, s.repositories, s.live) for s in got[50]] == [(2, 29, 3, 1, 1, True), (40, 67, 3, 1, 1, True)]
    base = spark.createDataFrame([(i, f"r{i}", f"o{i}", "token = 'abcdefabcdef99'") for i in range(4)], df.schema)
    assert [(s.kind, s.owners, s.live) for s in secrets.secrets(base, "owner", "repo").first().spans] == [(0, 4, False)]


def test_secrets_of_odd_rows(odd, nothing):
    rows = secrets.secrets(odd).collect()
    assert len(rows) == odd.count()
    assert [len(r.spans) for r in rows if r.doc_id == 13] == [2] and not any(r.spans for r in rows if r.doc_id in (2, 3, 4, 12, None))
    assert secrets.secrets(nothing).count() == 0


# pseudonyms


def test_feistel_permutes_its_domain(spark):
    for left, right in ((10, 10), (7, 13), (1, 30), (27, 3)):
        x = spark.range(left * right).select(pseudonyms.feistel(F.col("id"), left, right, "k", "d").alias("y"))
        assert sorted(r.y for r in x.collect()) == list(range(left * right))
    texts = spark.range(1000).select(pseudonyms.feistel_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "d").alias("y"))
    assert len({r.y for r in texts.collect()}) == 1000
    assert [pseudonyms_of(spark, "a 10.1.2.3", k) for k in ("k1", "k1")][0] != pseudonyms_of(spark, "a 10.1.2.3", "k2")


def pseudonyms_of(spark, text, key="key"):
    return pseudonyms.with_pseudonyms(spark.createDataFrame([(text,)], "text string"), key).first().text


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def test_pseudonyms_keep_format_validity_and_links(spark):
    text = "4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111111111111112. 2024-02-29 and 29.02.2024, 29/02/2024; 2023-02-29. 078-05-1120, 000-11-2222. 10.0.0.1 300.1.1.1 joe.5@a.example.org x joe.5@b.org +1 (017) 555-7713"
    out = pseudonyms_of(spark, text)
    assert out == pseudonyms_of(spark, text)
    shape = lambda t: re.sub("[0-9]+", lambda m: "9" * len(m.group()) if len(m.group()) > 3 else "9", re.sub("[a-z]", "a", t))
    assert shape(out) == shape(text)
    cards = re.findall(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", out)
    plain = [re.sub(r"\D", "", c) for c in cards]
    assert plain[0] == plain[1] and [luhn(c) for c in plain] == [True, True, False] and "4111" not in out
    dates = re.findall(r"(\d{4})-(\d{2})-(\d{2})|(\d{2})[./](\d{2})[./](\d{4})", out)
    assert dates[0][:3] == dates[1][5:2:-1] == dates[2][5:2:-1] and dates[0][:3] != ("2024", "02", "29")
    assert "2023-02-29" in out and "000-11-2222" in out and "300.1.1.1" in out and "10.0.0.1 " not in out and "078-05-1120" not in out
    a, b = re.findall(r"(\S+)@", out)
    local = pseudonyms_of(spark, "(017) 555-7713, 017-555-7713, 017.555.7713, 1.017.555.7713")
    found = re.findall(r"\d{3}\D{1,2}\d{3}\D\d{4}", local)
    assert len({re.sub(r"\D", "", f) for f in found[:3]}) == 1 and "555-7713" not in local and local.endswith(", 1.017.555.7713")
    assert a == b != "joe.5" and "@a.example.org" in out and out.split("+1 ")[1] != "(017) 555-7713"


@pytest.mark.parametrize("one,other", [
    ("+1 555 123 4567", "+15551234567"), ("+420 123 456 789", "+420123456789"), ("+44 20 7946 0958", "+442079460958"), ("+7 (912) 345-67-89", "+79123456789"), ("+254 700-123-456", "+254700123456"),
])
def test_a_number_has_one_pseudonym_however_it_is_written(spark, one, other):
    a, b = pseudonyms_of(spark, f"call {one} now").removeprefix("call ").removesuffix(" now"), pseudonyms_of(spark, other)
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != re.sub(r"\D", "", one) and re.sub(r"\d", "9", a) == re.sub(r"\d", "9", one)
    code = one[1:].split(" ")[0]
    assert a.startswith(f"+{code}") and b.startswith(f"+{code}")


def test_dates_month_first_and_addresses_beyond_ascii(spark):
    out = pseudonyms_of(spark, "born 12/31/1985 or 12-31-1985, not 13/32/1985; жора@x.com and Жора@x.com, jürgen.ß@y.de")
    assert "1985-" not in out and "12/31/1985" not in out and "12-31-1985" not in out and "13/32/1985" in out
    one, two = re.findall(r"(\d{2}[/-]\d{2}[/-]\d{4})", out)[:2]
    assert one.replace("/", "-") == two
    a, b, c = re.findall(r"(\S+)@", out)
    assert re.fullmatch("[а-яё]{4}", a) and re.fullmatch("[А-ЯЁ][а-яё]{3}", b) and a != "жора" and b != "Жора" and c.split(".")[0] != "jürgen" and len(c) == len("jürgen.ß")


def test_every_number_in_the_documents_is_replaced(documents):
    new = pseudonyms.with_pseudonyms(documents.withColumnRenamed("text", "t").withColumn("text", F.col("t")), "key")
    found = re.compile(r"\S+@\S+\.com|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d+\.\d+\.\d+\.\d+")
    n = 0
    for r in new.collect():
        values = found.findall(r.t)
        n += len(values)
        assert not any(v in r.text for v in values)
        if not values and not r["__llm_found"]:
            assert r.text == r.t
    assert n > 0


def test_pseudonyms_of_odd_rows(odd, nothing):
    out = pseudonyms.with_pseudonyms(odd, "k")
    assert out.columns == [*odd.columns, "__llm_found"]
    assert [(r.doc_id, r.text) for r in out.collect()] == [(r.doc_id, r.text) for r in odd.collect()]
    assert pseudonyms.with_pseudonyms(nothing, "k").count() == 0


# line chunks


def cut(text):
    """The operator's own kernel on one text."""
    import numpy as np

    data = np.frombuffer((text or "").encode(), np.uint8)
    held = lines.Lines(data, np.array([0, len(data)]))
    return held, list(zip(*(x.tolist() for x in held.chunks(lines.DIVISOR, lines.PAIRS))))


def brute_chunks(docs, share=None):
    """The operator's rule over chunks as its own kernel cuts them; which of them repeat is found by comparing their bytes.

    With ``share`` texts that lose so much to one other stay whole, unless they lose all."""
    first, spans = {}, {}
    for d, text in sorted(docs):
        held, found = cut(text)
        spans[d] = held, []
        for a, b in sorted(found):
            content = bytes(held.data[held.start[a] : held.start[b] + held.length[b]])
            origin = first.setdefault(content, (d, a, b))
            if origin != (d, a, b):
                spans[d][1].append((a, b, origin[0]))
    out = {}
    for d, text in docs:
        held, found = spans[d]
        gone = {i for a, b, _ in found for i in range(a, b + 1)}
        if share is not None and len(gone) < len(held.text):
            for other in {o for *_, o in found}:
                lost = sum(int(held.length[i]) for i in {i for a, b, o in found if o == other for i in range(a, b + 1)})
                if lost >= share * (int(held.length.sum()) + int(spans[other][0].length.sum()) - lost):
                    gone = set()
        raw, at, kept = (text or "").encode(), 0, b""
        for i in sorted(gone):
            kept += raw[at : held.start[i]]
            at = int(held.next[i])
        out[d] = ((kept + raw[at:]).decode() if text is not None else None, len(gone))
    return out


def test_line_chunks_match_brute_force(spark, documents, pairs):
    rng = random.Random(4)
    block = [f"common line {i}" for i in range(30)]
    made = [(1000 + i, "\n".join([f"own {i} {rng.random()}"] * (i % 3) + block[i % 5 : 30 - i % 4] + [f"end {i}"])) for i in range(30)]
    made += [(2000, "a\na\na\na\nb"), (2001, "x\n\na\n\n\nb\n"), (2002, "a\n \nb"), (2003, "one line"), (2004, "one line\n"), (2005, "\n\n"), (2006, "x\n\na\n\n\nb\nend")]
    docs = pairs + made
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r["__llm_kept"], r["__llm_gone_lines"]) for r in lines.without_repeated_chunks(df, ["doc_id"]).collect()}
    assert got == brute_chunks(docs)
    shared = [got[1000 + i][1] for i in range(1, 30)]
    assert sum(shared) > 0.95 * 29 * 26  # boundaries are found again after shifted starts


def test_chunks_do_not_depend_on_their_surroundings():
    rng = random.Random(1)
    passage = [f"line {i} {rng.random()}" for i in range(9)]
    inside = lambda before, after: {(a - len(before), b - len(before)) for a, b in cut("\n".join([*before, *passage, *after]))[1] if a >= len(before) and b < len(before) + len(passage)}
    want = inside([], [])
    assert want and all(b > a for a, b in want)
    for i in range(20):
        assert inside([f"before {i} {j}" for j in range(i % 4)], [f"after {i} {j}" for j in range(i % 3)]) == want


def test_chunk_hashes_follow_the_lines():
    import numpy as np

    text = "\n".join(["p", "q", "r", "s", "x", "p", "q", "r", "s", "y", "q", "r"])
    held, _ = cut(text)
    first, last = np.array([0, 5, 0, 1, 6, 10, 0]), np.array([3, 8, 2, 2, 7, 11, 0])
    h = held.hashes(first, last).tolist()
    assert h[0] == h[1] and h[3] == h[4] == h[5] and len(set(h)) == 4


def test_equal_hashes_alone_remove_nothing(spark, monkeypatch):
    """With hashes that are all equal, bytes still decide; two variants under both hashes are joined by their bytes."""
    import numpy as np

    docs = [(i, f"first {i % 3}\nsecond {i % 3}\nthird {i}") for i in range(9)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute_chunks(docs)
    monkeypatch.setattr(lines.Lines, "hashes", lambda self, first, last: np.zeros(len(first), np.uint64))
    constant = lambda *c: F.lit(5).cast("long") if len(c) > 1 else F.hash(*c).cast("long")
    monkeypatch.setattr(lines.F, "xxhash64", constant)
    assert {r.doc_id: (r["__llm_kept"], r["__llm_gone_lines"]) for r in lines.without_repeated_chunks(df, ["doc_id"]).collect()} == want


def test_line_chunks_of_odd_rows(odd, nothing):
    rows = lines.without_repeated_chunks(odd, ["doc_id"]).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == odd.count()
    assert got[2]["__llm_kept"] is None and got[3]["__llm_kept"] == "" and got[4]["__llm_lines"] == 2
    assert len({r["__llm_kept"] for r in rows if r.doc_id == 12}) == 1
    out = lines.with_unique_chunks(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert lines.with_unique_chunks(nothing).count() == 0


def brute_passages(docs, size=2):
    """Lines that go: those of any run of ``size`` lines that stands earlier too. The texts have no empty lines."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        own, gone = (text or "").split("\n"), set()
        for i in range(len(own) - size + 1):
            run = tuple(own[i : i + size])
            if run in seen:
                gone |= set(range(i, i + size))
            seen.add(run)
        out[d] = [x for i, x in enumerate(own) if i not in gone], len(gone)
    return out


@pytest.fixture(scope="module")
def planted():
    """Passages of 2 to 6 lines, each in three texts with other lines around it; single common lines; a run that follows itself."""
    rng = random.Random(8)
    own = lambda: [f"own {rng.random()}" for _ in range(rng.randrange(1, 6))]
    docs = []
    for size in range(2, 7):
        for p in range(40):
            passage = [f"passage {size} {p} line {i} {rng.random()}" for i in range(size)]
            docs += [own() + passage + own() + ["common line"] + own() for _ in range(3)]
    rng.shuffle(docs)
    docs += [["a", "a", "a", "a", "b"], ["x", "a", "b"], ["a", "a"]]
    return [(i, "\n".join(x)) for i, x in enumerate(docs)]


def recall(kept, docs):
    """Of the lines that go by the yardstick (any two lines that stand earlier too), the share that went, by size of the passage."""
    want, left, total = brute_passages(docs), dict.fromkeys(range(2, 7), 0), dict.fromkeys(range(2, 7), 0)
    for d, text in docs:
        gone, rest = set(text.split("\n")) - set(want[d][0]), set(kept[d].split("\n"))
        for line in gone:
            if line.startswith("passage "):
                total[int(line.split()[1])] += 1
                left[int(line.split()[1])] += line in rest
    return {size: 1 - left[size] / total[size] for size in total}


def test_short_passages_in_other_surroundings_go(spark, planted):
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in lines.without_repeated_chunks(df, ["doc_id"]).collect()}
    found = recall({i: r["__llm_kept"] for i, r in got.items()}, planted)
    assert all(share >= 0.9 for share in found.values()), found
    want = brute_passages(planted)
    for i, text in planted:  # nothing goes that the yardstick keeps, and one copy of every line stays
        assert not [x for x in want[i][0] if x and x not in got[i]["__llm_kept"].split("\n")]
    assert {x for r in got.values() for x in r["__llm_kept"].split("\n") if x} == {x for _, t in planted for x in t.split("\n")}
    assert all(r["__llm_gone_chunks"] <= r["__llm_chunks"] for r in got.values())


def test_op10_takes_short_passages(spark, planted, tmp_path):
    from tallyspark.llm import queries

    spark.createDataFrame(planted, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in queries.QUERIES["op10_line_chunks"](spark, str(tmp_path)).collect()}
    assert got == brute_chunks(planted)


def test_near_copies_stay_whole(spark):
    """Texts whose copies have an edited word are left to the next stage; texts that share a passage with several others are cut."""
    rng = random.Random(6)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(8))
    docs, edited = [], set()
    for i in range(20):
        base = [line() for _ in range(rng.randrange(15, 31))]
        docs.append((3 * i, "\n".join(base)))
        for c in (1, 2):
            other = base.copy()
            other[rng.randrange(len(base))] += f" edited {c}"
            docs.append((3 * i + c, "\n".join(other)))
            edited.add(3 * i + c)
    footer = [line() for _ in range(4)]
    docs += [(100 + i, "\n".join([line() for _ in range(10)] + footer)) for i in range(5)] + [(200, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in lines.with_unique_chunks(df).collect()}
    whole = dict(docs)
    assert 200 not in got and all(got[i] == whole[i] for i in [*edited, *range(0, 60, 3), 100])
    assert all(len(got[i]) < len(whole[i]) for i in range(101, 105))
    cut_too = {r.doc_id: r.text for r in lines.with_unique_chunks(df, near_copies=None).collect()}
    assert sum(cut_too.get(i) != whole[i] for i in edited) == len(edited)


def test_copies_of_whole_texts_leave_no_remnant(spark):
    rng = random.Random(3)
    texts = ["\n".join(f"text {i} line {j} {rng.random()}" for j in range(size)) for i, size in enumerate([2, 3, 4, 5, 7, 10, 20, 50] * 5)]
    more = "\n".join(f"another line of its own {j}" for j in range(9))
    docs = [(i, t, len(t)) for i, t in enumerate(texts * 3)] + [(500, "of its own\n" + texts[3] + "\n\nand this\n" + more, 0)]
    out = lines.with_unique_chunks(spark.createDataFrame(docs, "doc_id long, text string, n_chars long"))
    rest = "of its own\nand this\n" + more
    assert sorted(map(tuple, out.collect())) == [*((i, t, len(t)) for i, t in enumerate(texts)), (500, rest, len(rest))]
