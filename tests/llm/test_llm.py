"""The llm operators against brute force, exact round trips and labels, and on the cases their docstrings name."""

import random

import duckdb
import pytest
from compare import connect, differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sporlake.llm import abuse, leakage, linkage, names, queries, survivor, tokenizer, words


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, sf_small, name):
    assert differences(spark, connect(sf_small), name, queries.QUERIES[name], queries.SQL[name], sf_small) == ""


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


# ---- surviving claims

RAW = "claim_id long, organisation_number string, claim_key string, field_name string, value string, source_authority int, evidence_span string, retrieved_at string, effective_date string, reporting_period string, evidence_id long, g string, id long, trust long, at string, bucket string"
CLASH = ("c", 0, 0, "c", "c")


def raw(i, key, value, auth=None, at="2025-01-01T00:00:00Z", ev=None, span=None, eff=None, per=None, org="974760673", field="employees"):
    return (i, org, key, field, value, auth, span, at, eff, per, ev, *CLASH)


def survivors(spark, data, evidence=(), **kw):
    e = spark.createDataFrame(list(evidence), "evidence_id long, source_class string, id long")
    c = spark.createDataFrame([("official_registry", 100, "UTC"), ("directory", 10, "UTC")], "source_class string, source_authority int, local_zone string")
    return rows(survivor.surviving_claims(spark.createDataFrame(data, RAW), e, c, **kw), "group_id", "field", "claim_id")


def test_survivors(spark):
    k = "org:974760673|field:employees"
    assert survivors(spark, []) == []
    assert survivors(spark, [raw(1, k, "1")]) == []  # one row is no group
    data = [raw(5, k, "ukjent", 100), raw(7, "ORG: 974 760 673 | field: EMPLOYEES", "4", 50, None), raw(3, "field:employees|org:NO974760673MVA", "5", 50), raw(9, k, "6", 50, "2025-01-01T03:00:00+03:00"), raw(2, "org:974760673|field:employees|entity:y", "7", 100)]
    assert survivors(spark, data) == [(3, "value", 3)]
    # trust through the evidence, however its class is written; an unknown one is lowest
    data = [raw(1, k, "1", None, ev=1), raw(2, k, "2", None, ev=2), raw(3, k, "3", 20), raw(4, k, "4", None, ev=99)]
    assert survivors(spark, data, [(1, "officialRegistry ", 0), (2, "other", 0)]) == [(1, "value", 1)]
    # fields survive apart; nulls in any column don't fail; rows without a key are in no group
    data = [raw(1, k, None, 9, span="a b"), raw(2, k, "2", 1, eff="2020", per="N/A"), raw(3, None, "x", 1, org=None, field=None), raw(4, "nonsense", "x", 1, org=None, field=None)]
    assert survivors(spark, data) == [(1, "effective_date", 2), (1, "evidence_span", 1), (1, "value", 2)]


def test_survivor_of_hot_group_and_long_texts(spark):
    k = "org:974760673|field:employees"
    data = [raw(i, k, f"value {i % 97} " + "w " * (i % 5), i % 50, f"2025-01-01T00:{i % 60:02d}:00Z") for i in range(1, 3001)] + [raw(9000, k, "x " * 20_000, 49, "2020-01-01T00:00:00Z")]
    best = max((r for r in data), key=lambda r: (r[5], r[7], -r[0]))
    assert survivors(spark, data) == [(1, "value", best[0])]


def test_consensus():
    ranked = [((3, 0, 0), "Oslo gate 1"), ((2, 0, 0), "Oslo veien 1"), ((1, 0, 0), "Oslo veien 1 A")]
    assert survivor.consensus(ranked)[1] == "Oslo gate 1"
    # by trust alone the middle wins: two of three say "veien", two have no "A"
    assert survivor.consensus(ranked, [4, 3, 2])[1] == "Oslo veien 1"


@pytest.mark.parametrize("weight", ["dominant", "trust"])
def test_order_and_partitions_do_not_show(spark, weight):
    rng = random.Random(4)
    k = "org:974760673|field:employees"
    streets = ["Kirkegata", "Storgata", "Kirkegaten"]
    data = [raw(i, k, f"{rng.choice(streets)} {rng.randrange(60)} {rng.choice('ab')} Oslo", rng.randrange(4), f"2025-01-0{rng.randint(1, 9)}T00:00:00Z") for i in range(200)]
    seen = set()
    for n in range(8):
        rng.shuffle(data)
        d = spark.createDataFrame(data, RAW).repartition(1 + n % 3)
        e, c = spark.createDataFrame([], "evidence_id long, source_class string"), spark.createDataFrame([], "source_class string, source_authority int")
        seen.add(tuple(rows(survivor.surviving_claims(d, e, c, weight), "group_id", "field", "claim_id")))
    assert len(seen) == 1


def test_votes_of_several_sources(spark):
    k = "org:974760673|field:employees"
    data = [raw(1, k, "Oslo gate 1", 3), raw(2, k, "Oslo veien 1", 2), raw(3, k, "oslo veien 1", 0), raw(4, k, "Oslo veien 1", 2)]
    assert survivors(spark, data) == [(1, "value", 1)]
    assert survivors(spark, data, weight="trust") == [(1, "value", 2)]
    assert survivors(spark, [], weight="trust") == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.text("ab c", max_size=8)), min_size=1, max_size=70))
def test_dominant_weights_follow_the_rank(data):
    ranked = sorted((((t, r, -i), x) for i, (t, r, x) in enumerate(data)), reverse=True)
    assert survivor.consensus(ranked) == ranked[0]


def test_nothing_is_aligned_where_the_rank_decides(spark, sf, monkeypatch):
    plan = queries.p1_found(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" in plan and "Arrow" not in plan  # no pass of Python over texts

    def align(*_):
        raise AssertionError("aligned")

    monkeypatch.setattr(survivor, "align", align)
    ranked = [((2, 0, 0), "Oslo gate 1"), ((1, 0, 0), "Oslo veien 1 A")]
    assert survivor.consensus(ranked) == ranked[0]
    with pytest.raises(AssertionError, match="aligned"):
        survivor.consensus(ranked, [2, 1])


# ---- names


@pytest.fixture(scope="module")
def trades():
    return names.Trades(["elektro", "regnskap", "frukt og grønt", "mekaniske verksted", "handelskompani", "maskinutleie"])


@pytest.mark.parametrize(
    "typed,name",
    [
        ("drorkhest kånhum el. as", "Drørkhest Kånhum Elektro AS"), ("Drørkhestkånhum", "Drørkhest Kånhum Elektro AS"), ("ELEKTRO DRØRKHEST-KAANHUM A/S", "Drørkhest Kånhum Elektro AS"), ("D. Kånhum Elektro", "Drørkhest Kånhum Elektro AS"),
        ("Kånhum / Drørkhest", "Drørkhest og Kånhum Elektro AS"), ("Fred Sarler-Våndtønd ENK", "Fredrik Sarlervåndtønd Regnskap"), ("Sarlervandtond, F. Regnsk.", "Fredrik Sarlervåndtønd Regnskap"), ("s. styrdym", "Stastbarstyrdym Elektro AS"),
        ("Vømgum Kållol Fruk tog Grønt", "Vømgum Kållol Frukt og Grønt AS"), ("Vømgum Kållol Hdl.komp.", "Vømgum Kållol Handelskompani AS"), ("Vorngum Kållol", "Vømgum Kållol Handelskompani AS"), ("Vømgum Kållol Ansvarlig selskap", "Vømgum Kållol Elektro ANS"),
    ],
)
def test_readings_of_names(spark, trades, typed, name):
    core, trade, legal = names.parse_registered(name, trades)
    rewritings = names.registered_rewritings(core, legal)
    exact = any(set(names.typed_rewritings(c)) & rewritings and t in (None, trade) for c, t, _ in names.readings(typed, trades))
    assert exact or met(spark, [(typed, name)], trades) == [True]


def met(spark, pairs, trades):
    """Whether typed names meet the registered ones by a key and are within the allowed edits."""
    typed = [(i, c, t) for i, (x, _) in enumerate(pairs) for c, _, lf in names.readings(x, trades) for t in names.typed_texts(c, lf)]
    reg = [(i, p[0], t) for i, (_, x) in enumerate(pairs) if (p := names.parse_registered(x, trades)) for t in names.registered_texts(p[0], p[2])]
    frame = lambda rows, typed: spark.createDataFrame([(i, " ".join(c), *t) for i, c, t in rows], "i int, core string, kind string, text string, beside string, cost double").withColumn("k", linkage.end_keys(F.col("kind"), F.col("text"), F.col("beside"), typed))
    a, b = [[tuple(r) for r in frame(x, t).collect()] for x, t in ((typed, True), (reg, False))]
    ok = lambda x, y: set(x[6]) & set(y[6]) and (d := names.distance(x[3], y[3], 3)) <= names.most_edits(x[2], len(x[3]), len(y[3]), len(x[4]) and len(y[4])) and names.fits(x[2:6], x[1].split(), y[2:6], y[1].split(), d)
    return [any(ok(x, y) for x in a if x[0] == i for y in b if y[0] == i) for i in range(len(pairs))]


@pytest.mark.parametrize("typed,core", [("fojgrunhenfork", "Fjogrin Henfork"), ("sondorkinlyn", "Sondir Kunlyn"), ("bmnandtasin", "Bamnan Drasin"), ("hamhulkvogndtal", "Hamhulkvongdal"), ("den gode gamle norske sjo mans hjem as", "Den Gode Gamle Norske Sjo Manns Hjem AS")])
def test_names_with_errors_at_both_ends_meet(spark, trades, typed, core):
    assert met(spark, [(typed, core)], trades) == [True]


def edited(name, rng, edits):
    for _ in range(edits):
        i = rng.randrange(max(1, len(name)))
        name = rng.choice([name[:i] + name[i + 1 :], name[:i] + rng.choice("aeklrst") + name[i:], name[:i] + rng.choice("aeklrst") + name[i + 1 :], name[:i] + name[i : i + 2][::-1] + name[i + 2 :]])
    return name


def test_every_name_within_the_allowed_edits_meets(spark):
    rng = random.Random(5)
    cores = ["".join(rng.choice("abdefgiklmnorstuv") for _ in range(rng.randint(5, 26))) for _ in range(400)]
    typed = [edited(c, rng, rng.randint(1, 3)) for c in cores]
    near = [i for i, (x, y) in enumerate(zip(typed, cores)) if names.distance(x, y, 3) <= names.most_edits("C", len(x), len(y), 0)]
    assert len(near) > 200
    rows_ = spark.createDataFrame([(i, typed[i], cores[i]) for i in near], "i int, a string, b string")
    k = rows_.select(F.arrays_overlap(linkage.end_keys(F.lit("C"), F.col("a"), F.lit(""), True), linkage.end_keys(F.lit("C"), F.col("b"), F.lit(""), False)).alias("k"))
    assert k.where("not k").count() == 0


def test_distances_are_those_of_single_pairs():
    rng = random.Random(3)
    a = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    b = [edited(x, rng, rng.randint(0, 4)) for x in a]
    assert names.distances(a, b).tolist() == [names.distance(x, y, 3) for x, y in zip(a, b)]


def test_linkage_recall_on_generated_names(spark):
    """Names and writings made here, apart from the test tables: at least 99 of 100 are linked, to the right company."""
    rng = random.Random(11)
    part = lambda: "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiouy") for _ in range(rng.randint(3, 5))).capitalize()
    first = ["William", "Margaret", "Anders", "Cecilie", "Robert", "Ingrid"]
    co, typed = [], []
    for i in range(300):
        a, b, trade = part(), part(), rng.choice(["Elektro", "Regnskap", "Malerservice"])
        person = i % 5 == 0
        f = rng.choice(first)
        co.append((str(i), f"{f} {a + b} {trade}" if person else f"{a} {b} {trade} AS"))
        if person:
            nick = {"William": "Bill", "Margaret": "Peggy", "Robert": "Bob"}.get(f, f[:3])
            typed.append((i, rng.choice([f"{nick} {a + b} {trade}", f"{f[0]}. {a + b} {trade[:5]}.", f"{a + b}, {f}", f"{f} {edited(a + b, rng, 1)}"]), None))
        else:
            typed.append((i, rng.choice([f"{b} {a} {trade}", f"{a}{b} {trade[:4]}. a.s.", f"{trade} {a}-{b}".upper(), edited(a, rng, 1) + f" {b} {trade} AS", f"{a} {edited(b, rng, 1)} {trade}", edited(a + b, rng, 2)]), None))
    got = dict(meant(spark, typed, co))
    assert sum(got.get(i) == str(i) for i in range(300)) >= 297
    assert sum(i in got and got[i] != str(i) for i in range(300)) <= 1


@pytest.mark.parametrize("typed", ["Drørkhest Nulvrol Elektro AS", "-", "", "privat", "Styreleder", "Drørkhest", "x" * 5000, "Topp 11: elektro i Lund"])
def test_no_readings_of_other_names(spark, trades, typed):
    assert met(spark, [(typed, "Drørkhest Kånhum Elektro AS")], trades) == [False]


def meant(spark, typed, companies):
    co = spark.createDataFrame([(o, n, "Virksomhet innen " + (n.split()[-2] if n.endswith(("AS", "SA")) else n.split()[-1]).lower(), 1) for o, n in companies], "organisation_number string, name string, industry_label string, org int") if companies else spark.createDataFrame([], "organisation_number string, name string, industry_label string, org int")
    rec = spark.createDataFrame([("o", i, t, False, g, None, 1) for i, t, g in typed], "origin string, record_id long, text string, title boolean, target string, target_name string, org int")
    return rows(linkage.meant_companies(rec, co), "record_id", "organisation_number")


def test_meant_companies(spark):
    co = [("1", "Vømgum Kållol Elektro AS"), ("2", "Vømgum Kållol Regnskap AS"), ("3", "Bruntist Skolvend Elektro AS"), ("3", "BRUNTIST SKOLVEND ELEKTRO AS")]
    typed = [(1, "vømgum kållol el.", None), (2, "Vømgum Kållol", "2"), (3, "Vømgum Kållol", "3"), (4, "Vømgum Kållol", None), (5, None, "1"), (6, " ", "1"), (7, "Bruntitst Skolvend", None), (7, "Bruntitst Skolvend", None), (8, "Zwaqrix Kållol Elektro AS", "1")]
    assert meant(spark, typed, co) == [(1, "1"), (2, "2"), (7, "3")]
    assert meant(spark, typed, []) == [] and meant(spark, [], co) == []


# ---- tokenizer


def test_no_side_of_the_linkage_is_gathered_in_the_driver(spark, sf_small, monkeypatch):
    plans = []
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    cut = linkage.cut
    monkeypatch.setattr(linkage, "cut", lambda df: planned(df) or cut(df))
    planned(queries.p5_found(spark, sf_small))
    # 9,903 counted forms pass for 2,631 bytes, so the planner would send forms of any register.
    assert len(plans) == 6 and not [p for p in plans if "Broadcast" in p]


@pytest.fixture(scope="module")
def whole():
    """The ids of a whole text by another implementation of the same tokenizer."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def encoded(spark, data, **kw):
    return dict(rows(tokenizer.token_ids(spark.createDataFrame(data, "doc_id long, text string, id long, ids string"), **kw), "doc_id", "ids"))


def test_token_ids(spark, whole):
    texts = ["", None, "Hei, it's we're ''re", "a " * 4000 + "  \n\n x", "x" * 9000, " " * 9000 + "b", "日本語 ǻ " * 900, "<|endoftext|>" * 800, "1234567890" * 700, "\r\n\t" * 2500]
    want = {i: whole(x) for i, x in enumerate(texts)}
    for kw in ({}, {"chunk": 40, "overlap": 7}):
        got = encoded(spark, [(i, x, 0, "c") for i, x in enumerate(texts)], **kw)
        assert got == want
        assert all(tokenizer.decode(got[i]) == (x or "") for i, x in enumerate(texts))
    assert encoded(spark, []) == {}


def test_token_ids_keep_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(len(r.ids) for r in tokenizer.token_ids(d).collect()) == [1, 2, 2]


def test_token_ids_of_the_corpus(spark, sf_small, whole):
    d = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.select("doc_id", "text").collect()}
    for r in tokenizer.token_ids(d, chunk=300, overlap=60).collect():
        assert list(r.ids) == whole(texts[r.doc_id])


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab' \n\t1.é日re"), max_size=120), st.integers(6, 30), st.integers(4, 12))
def test_stitched_pieces_encode_as_the_whole(text, chunk, overlap):
    enc = tokenizer.encoding()
    assert [i for x in tokenizer.pieces(text, chunk, overlap) for i in enc.encode_ordinary(x)] == enc.encode_ordinary(text)


# ---- leakage

ITEM = "Before the disputed strike, Klandsten partly swapped 4224 numbered pianos near Kostdøn, though the deputy from Mundvym mortgaged 3110 portraits. Which entity bears the loss?"


def leaked(spark, texts, items=((1, ITEM),)):
    d = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, t string")
    return rows(leakage.leaked_items(d, spark.createDataFrame(list(items), "item_id long, text string")).select("doc_id", "item_id"), "doc_id", "item_id")


def test_leaks(spark):
    w = ITEM.split()
    swapped = list(w)
    swapped[5], swapped[9] = "quietly", "violins"
    hits = [
        ITEM.upper(), "Intro. " + " ".join(w[3:16]) + " outro", "<p>" + "&nbsp;".join(f"<b>{x}</b>" for x in w) + "</p>", ITEM.replace("a", "а").replace("e", "е"), ITEM.replace("mortgaged", "mort-\ngaged").replace(" ", "\n> "), " ".join(swapped), " ".join(w[:6] + w[7:]), " ".join(w[:6] + ["very"] + w[6:]),
        ITEM.replace("ø", "Ã¸"), ITEM.replace("ø", "\\u00f8"), "x " * 30_000 + ITEM, "".join(c + ("​" if c == "t" else "") for c in ITEM),
    ]
    misses = [" ".join(w[3:11]), None, "", "The deputy from Oslo swapped pianos. Which entity bears the loss?", " ".join(reversed(w))]
    assert leaked(spark, [*hits, *misses, hits[0]]) == [(i, 1) for i in range(len(hits))] + [(len(hits) + len(misses), 1)]
    assert leaked(spark, hits, ()) == [] and leaked(spark, []) == []
    assert leaked(spark, [ITEM], [(1, ITEM), (1, ITEM), (2, None), (3, "")]) == [(0, 1)]


def test_smith_waterman():
    import numpy as np

    a = np.arange(20)
    assert leakage.smith_waterman(a, np.array([99, 3, 4, 5, 99, 7, 8, 9])) == (3, 10, 6)


def test_weak_copy_does_not_hide_a_passage(spark):
    w = ITEM.split()
    weak = " ".join(x if i % 9 in (0, 2, 4, 5, 7) else f"other{i}" for i, x in enumerate(w))
    run, far = " ".join(w[4:16]), " ".join(f"far{i}" for i in range(40))
    assert leaked(spark, [weak]) == []
    assert leaked(spark, [f"{run} {weak}", f"{run} {far} {weak}", f"{weak} {far} {run}", f"{run} {'far ' * 400} {weak}"]) == [(i, 1) for i in range(4)]
    # nor does it make one of nine words and a word more by chance
    assert leaked(spark, [" ".join(w[4:13]) + f" a b {w[15]} {weak}"]) == []
    # words that another item has, all of them, are no swapped words of one that is alike
    other = "the adjourned hearing whereas the creditor from Klolvdrom demanded 3201 keys. What sum remains outstanding?"
    alike = "the inherited hearing, provided the creditor from Kølkurk demanded 4824 keys. What sum remains outstanding?"
    assert leaked(spark, [other], [(1, alike), (2, other)]) == [(0, 2)]


def test_repeated_and_alike_items_are_all_found(spark):
    w = ITEM.split()
    equal = [(i, ITEM) for i in range(400)]
    assert leaked(spark, ["intro " + " ".join(w[5:20]), "nothing"], equal) == [(0, i) for i in range(400)]
    # templated items: each text leaks its own item, found by pairs that most items have
    alike = [(i, " ".join(f"{x}{i}" for x in ("the old hearing", "from some place", "of another creditor", "and a key", "with his clerk", "in that list", "what sum remains"))) for i in range(100)]
    assert leaked(spark, [alike[k][1] for k in (3, 50, 99)], alike) == [(0, 3), (1, 50), (2, 99)]


def test_passage_beside_other_words_of_its_item(spark):
    w = ITEM.split()
    run = " ".join(w[4:16])
    texts = [run, f"{run} a b c d e f {' '.join(w[18:22])}", f"{run} a b c d e f g {' '.join(w[17:24])}", f"{run} {'far ' * 90} {' '.join(w[::2])}"]
    assert leaked(spark, texts) == [(i, 1) for i in range(4)]


def test_without_a_filter_the_join_finds_the_same(spark):
    w = ITEM.split()
    d = spark.createDataFrame([(0, " ".join(w[3:17])), (1, "none of it, but which entity bears the loss"), (2, "x " * 50 + ITEM)], "doc_id long, text string")
    e = spark.createDataFrame([(1, ITEM), (2, "What sum remains outstanding after the creditor from the north demanded his keys again?")], "item_id long, text string")
    want = rows(leakage.leaked_items(d, e), "doc_id", "item_id")
    assert want == [(0, 1), (2, 1)]
    assert rows(leakage.leaked_items(d, e, most=0, sent_words=0), "doc_id", "item_id") == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=60))
def test_seeds_survive_three_edits(counts):
    keep = set(leakage.rarest(counts))
    n = leakage.PASSAGE - 1
    for k in range(max(1, len(counts) - n + 1)):
        assert len(keep & set(range(k, k + n))) >= min(leakage.SEEDS, len(counts))


def test_words():
    assert words.words("<p>BlÃ¥bær&nbsp;1 234 ﬁn</p> un-\nmarked") == words.words("blåbær 1234 fin unmarked")


# ---- abuse


@pytest.mark.parametrize(
    "text",
    ["You are a stupid m0r0n.", "Du er en fobranna tареr!", "Shut up, you b i t c h", "Sjefen er en r.a.s.s.h.ø.l som burde skamme seg", "Immigrants are l4zy $cum", "Alle utlendinger er rotter.", "THE BOSS IS A BASTAAAAARD", "you are a p13c3 0f $h1t", "Hold kjeft, din j̶æ̶v̶l̶a̶ ta*er", "Våre kåte ludder sender nakenbilder", "Nice shop. " * 500 + "You are an idiot."],
)
def test_abuse_is_found(text):
    assert abuse.abuse_score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [None, "", "  ", "The bastard file was put back in the drawer.", "Rats and vermin were found in the cellar and exterminated.", "The cock of the valve was stuck.", "This bloody mary is damn good.", "Idiotsikre låser.", "A court fined a man for hateful threats.", "Kurset handler om seksuell helse og brystkreft.", "You are here.", "Drittjobben tar vi oss av.", "x" * 100_000, "a " * 50_000],
)
def test_neutral_text_is_not(text):
    assert abuse.abuse_score(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    [
        "I will stab you tonight.", "Gypsies are thieves and must be gassed.", "Women like her belong in the kitchen, stupid cow.", "You are all worthless garbage and I hope you get run over.", "You are a Mroon.", "You are a MROON.", 'You are a "stupid" "moron".', "I'm going to kill you and your dog.", "Vil du knulle i kveld?",
        "Alle svarte burde skytes.", "Go back to the country you came from.", "Kvinner hører hjemme på kjøkkenet.",
    ],
)
def test_abuse_in_other_words_is_found(text):
    assert abuse.abuse_score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["He met Moran in town.", "I hope you enjoy the new office.", "Kill the process and restart the server.", "The pigs are fed twice a day on the farm.", "Vi skal kjøre dem hjem etter festen.", "The movie is about a whore in Victorian London.", 'The report said that "he is a moron and a bastard", which nobody confirmed.'])
def test_ordinary_uses_are_not_abuse(text):
    assert abuse.abuse_score(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize("text", ["Of course you are an idiot.", "Mary is a stupid bitch.", "I will kill you, judge.", "You are an idiot, and the valve is broken.", "The judge is an idiot.", "The court date is late and you are a moron.", "Det betyr at du er en tulling.", "You idiot, file the drawer."])
def test_neutral_words_do_not_excuse_abuse(text):
    assert abuse.abuse_score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["I hope you\nchoke on it", "You are an\r\nidiot", "Du er en\n  tulling.", "Blowjob. Handjob.", "Ludder!\nKnulle!"])
def test_abuse_across_lines_and_sentences(text):
    assert abuse.abuse_score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["You are an\n\nidiot-proof lock", "Blowjob. A court case. Handjob.", "Porn.\nSeminar: porn and the patients."])
def test_other_lines_and_sentences_do_not_add_up(text):
    assert abuse.abuse_score(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize("text", ["This is a bastard file.", "A court fined a man for writing I will kill you to a guard.", "Tingretten dømte en mann for å skrive at du er en tulling.", "The master and slave cylinders were replaced and the bastard file was put back in the drawer.", "Rats are parasites in the lab."])
def test_reports_and_trades_are_not_abuse(text):
    assert abuse.abuse_score(text)[0] < abuse.THRESHOLD


def test_automaton_is_damerau_levenshtein():
    terms = ("moron", "idiot", "rotter")
    t = abuse.Trie(terms)
    for word in ("moron", "mornon", "mroon", "morn", "xoron", "m?ron", "abc", "rottre", "idiotmoron"):
        letters = ["" if c == "?" else c for c in word]
        want = sorted((d, w) for w in terms if (d := names.distance(word.replace("?", w[min(word.find("?"), len(w) - 1)] if "?" in word else ""), w, 2)) <= 2)
        assert sorted(t.find(letters, 2)) == want


def test_abuse_against_labels(spark, sf_small):
    c = duckdb.connect()
    labels = dict(c.execute(f"select doc_id, max(toxic) from '{sf_small}/content_labels.parquet' group by 1").fetchall())
    score = {r.doc_id: r.score for r in abuse.scored(spark.read.parquet(f"{sf_small}/documents.parquet")).collect()}
    flagged = [i for i in labels if score[i] >= abuse.THRESHOLD]
    assert sum(labels[i] for i in flagged) / len(flagged) > 0.9
    assert sum(score[i] >= abuse.THRESHOLD for i in labels if labels[i]) / sum(labels.values()) > 0.75  # some labels are wrong


def test_abuse_tables(spark):
    d = spark.createDataFrame([(1, "You are an idiot.", "a", 9.0), (1, "You are an idiot.", "a", 9.0), (2, "Fine.", "a", 9.0), (None, "You are an idiot.", None, 9.0), (3, None, "b", 9.0)], "doc_id long, text string, source string, score double")
    assert rows(abuse.to_review(d), "doc_id") == [(1,)]
    assert {(r.source, r.documents, r.to_review, r.rate) for r in abuse.rates(d).collect()} == {("a", 3, 2, 0.666667), ("b", 1, 0, 0.0), (None, 1, 1, 1.0)}
    assert abuse.to_review(d.limit(0)).count() == 0
