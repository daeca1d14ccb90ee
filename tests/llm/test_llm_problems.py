"""Splits, percentiles, leaks, mixing and stuffing on small fixtures with awkward cases."""

import math
import random
from datetime import timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medlattice.llm import leaks, lexing, mixing, normal, quantiles, splits, stuffing
from tests.conftest import rows, ts
from tests.test_core_problems import NPX, PANEL, PANELS, reading


def uid(i):
    return f"{i:08x}-0000-4000-8000-000000000000"


TASKS = "task_row long, patient_id string, task string, component string, _s string"
LINKS = "link_id long, old_id string, new_id string, status string, linked_at timestamp_ntz, loaded_at timestamp_ntz, node string"


def link(i, a, b, status="confirmed", at="2020-01-01"):
    return (i, a, b, status, ts(at), ts("2021-01-01"), "x")


def test_same_entity(spark):
    tasks = [(i, p, "t", "c", "s") for i, p in enumerate([uid(1), uid(1).upper(), "{" + uid(1) + "}", uid(2), uid(3), uid(4), "n/a", "n/a ", None, "", " ", uid(1)])]
    links = [
        link(1, uid(1), uid(9)), link(2, uid(9), uid(8)), link(3, uid(2).upper(), uid(8), " CONFIRMED "), link(4, uid(3), uid(4)), link(5, uid(4), uid(3), "rejected", "2020-01-02"),
        link(6, uid(3), uid(3)), link(7, None, uid(3)), link(8, uid(4), None), link(9, uid(3), uid(1), "pending"), link(1, uid(1), uid(9)),
    ]
    member = splits.memberships(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(links, LINKS))
    smallest = min([uid(1), uid(1).upper(), "{" + uid(1) + "}", uid(2)])
    assert rows(splits.same_entity(member)) == sorted([(smallest, v) for v in {uid(1), uid(1).upper(), "{" + uid(1) + "}", uid(2)} - {smallest}], key=repr)
    out = splits.split_rows(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(links, LINKS))
    assert out.columns == [*TASKS.replace(" long", "").replace(" string", "").split(", "), "assigned_split"] and out.count() == len(tasks)
    assert out.where("assigned_split is null").count() == 0
    one = {r["assigned_split"] for r in out.collect() if r["patient_id"] and ("00000001" in r["patient_id"] or "00000002" in r["patient_id"])}
    assert len(one) == 1


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_against_union_find(spark, shape):
    random.seed(2)
    n = 120
    pairs = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(random.randrange(n), random.randrange(n)) for _ in range(90)]}[shape]
    parent = list(range(n + 1))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    df = spark.createDataFrame([(f"{a:04d}", f"{b:04d}") for a, b in pairs], "a string, b string")
    got = dict(rows(splits.connected(df)))
    assert got == {f"{x:04d}": f"{find(x):04d}" for p in pairs for x in p if p[0] != p[1]}


def test_splits_meet_shares_with_a_giant(spark):
    rows_ = [(i, uid(0) if i % 3 == 0 else uid(1 + i % 400), random.choice("ab"), "c", "s") for i in range(3000)]
    out = splits.split_rows(spark.createDataFrame(rows_, TASKS), spark.createDataFrame([], LINKS), shares={"train": 0.7, "validation": 0.15, "test": 0.15})
    report = {(r["scope"], r["split"]): r["share"] for r in splits.split_report(out, {"train": 0.7, "validation": 0.15, "test": 0.15}).collect()}
    assert abs(report["(all)", "train"] - 0.7) < 0.01 and abs(report["a", "test"] - 0.15) < 0.03
    assert out.groupBy("patient_id").agg(F.countDistinct("assigned_split").alias("n")).where("n > 1").count() == 0
    empty = splits.split_rows(spark.createDataFrame([], TASKS), spark.createDataFrame([], LINKS))
    assert empty.count() == 0


def test_splits_do_not_depend_on_partitions(spark):
    random.seed(3)
    data = [(i, uid(int(random.expovariate(1) * 300)), random.choice("abc"), "c", "s") for i in range(4000)]
    tasks, links = spark.createDataFrame(data, TASKS), spark.createDataFrame([], LINKS)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    made = set()
    try:
        for n, coalesce in ((1, "false"), (4, "false"), (7, "false"), (16, "true")):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
            made.add(tuple(rows(splits.split_rows(tasks.repartition(n), links).select("task_row", "assigned_split"))))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(made) == 1
    off = lambda rounds: splits.split_report(splits.split_rows(tasks, links, rounds=rounds)).agg(F.sum(F.pow(F.col("share") - F.col("target_share"), 2))).first()[0]
    assert off(3) < 0.1 * off(0)
    assert splits.split_check(tasks, links).where("not as_wanted or torn > 0").count() == 0


def test_anneal_keeps_the_best_state():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 9, (40, 3)).astype(float)
    start = rng.integers(0, 3, 40)
    total = x.sum(axis=0)
    off = np.stack([x[start == s].sum(axis=0) - total / 3 for s in range(3)])
    end = splits.anneal(x, start, off, 1 / total, rng, 20, 0.1)
    after = np.stack([x[end == s].sum(axis=0) - total / 3 for s in range(3)])
    assert ((after / total) ** 2).sum() < 0.1 * ((off / total) ** 2).sum()


VALUES = [0.0, -0.0, 1e-12, -1e-12, 1e-7, -1e-7, 0.5, -0.5, 1.0, 3.0, 1e6, -1e6, float("nan"), float("inf"), None] + [math.sin(i) * 10 ** (i % 5 - 2) for i in range(300)]


@pytest.mark.parametrize("error", [0.001, 0.02])
def test_percentiles_within_the_error(spark, error):
    df = spark.createDataFrame([("g", i % 3, v) for i, v in enumerate(VALUES)], "g string, day int, v double")
    points = [0, 0.01, 0.25, 0.5, 0.75, 0.999, 1]
    merged = quantiles.merge(quantiles.sketch(df, ["g", "day"], "v", error), ["g"])
    assert rows(merged) == rows(quantiles.sketch(df, ["g"], "v", error).select("g", "bucket", "n"))
    got = quantiles.percentiles(merged, ["g"], points, error).first()
    good = sorted(v for v in VALUES if v is not None and math.isfinite(v))
    assert got["n_values"] == len(good)
    for q in points:
        true = good[math.floor(q * (len(good) - 1))]
        assert abs(got[quantiles.name_of(q)] - true) <= max(error * abs(true) * (1 + 1e-9), quantiles.SMALLEST)


def test_npx_percentiles_and_empty(spark):
    data = [reading(i, "S", "X1A", v, group=g) for i, (v, g) in enumerate([(1.0, "case"), (2.0, " CASE"), (3.0, "n/a"), (-99.0, "case"), (None, None)])]
    npx, panels = spark.createDataFrame(data, NPX), spark.createDataFrame(PANELS, PANEL)
    got = {(r["scope"], r["group"]): r["n_values"] for r in quantiles.npx_percentiles(quantiles.npx_days(npx, panels)).collect()}
    assert got == {("protein", None): 3, ("protein_group", "case"): 2}
    assert quantiles.npx_percentiles(quantiles.npx_days(npx.where("false"), panels)).count() == 0


WORDS = "after breakfast the old porter carries seven green crates of lemons past the harbour clock while gulls argue about herring near the fish market stairs and nobody counts 37 coins left by Marlowe under the brass bell because rain from Kestrelton ruined every ledger kept in the dry cellar since early March".split()
ITEM = " ".join(WORDS) + ". Read the entire file first and tick exactly one of the boxes on the sheet."
ITEMS = [(1, ITEM), (2, "A second held out question speaks of nine blue kettles, two clumsy otters and one very patient ferry captain from Oldhaven. Read the entire file first and tick exactly one of the boxes on the sheet."), (3, "Third one about silver spoons that were lost between the orchard gate and the tall mill last winter. Read the entire file first and tick exactly one of the boxes on the sheet."), (4, None), (5, "")]
INDEX = leaks.build_index(ITEMS)
PAD = "Unrelated opening words of some other page. "


def found(text):
    return {c[0] for c in leaks.judge(text, INDEX)}


def test_leak_forms():
    half = " ".join(WORDS[5:32])
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in half)
    forms = [half, half.upper(), wide, half.replace("a", "а").replace("o", "о"), "​".join(half), "<p>" + half.replace(" ", "</b> <b>") + "</p>", half.replace(" ", "\n> "), '{"q": "' + half.replace(" ", "\\n") + '"}', half.replace(" ", "&nbsp; "), half.replace("l", "1").replace("o", "0")]
    forms += [" ".join(w if i % 6 else "(sic)" for i, w in enumerate(WORDS)), " ".join(w for i, w in enumerate(WORDS) if i % 7), " ".join(x for i, w in enumerate(WORDS) for x in ([w, "indeed"] if i % 8 == 0 else [w]))]
    forms += [" ".join(WORDS[26:]) + ". Something else. " + " ".join(WORDS[:26]), ITEM.replace("37", "82").replace("Marlowe", "Hutchins").replace("Kestrelton", "Dunmoor"), half.replace("harbour", "har-\nbour")]
    for f in forms:
        assert found(PAD + f + PAD) == {1}, f


def test_no_leaks():
    short = " ".join(WORDS[5:17])
    scattered = " ".join(x for k in range(0, 48, 5) for x in [*WORDS[k : k + 5], "something", "quite", "different", "here"])
    instruction = "Read the entire file first and tick exactly one of the boxes on the sheet."
    for text in (None, "", " ", short, scattered, instruction, instruction * 9, "word " * 5000, " ".join(sorted(WORDS))):
        assert found(text) == set()


def test_find_leaks(spark):
    docs = [(1, PAD + ITEM, "x"), (2, PAD + ITEM, "x"), (3, None, "x"), (4, "", "x"), (5, PAD * 20_000 + ITEM, "x"), (6, ITEMS[1][1] + ITEM, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([*ITEMS, ITEMS[0]], "item_id long, text string").withColumn("doc_id", F.lit("y"))
    want = [(1, 1), (2, 1), (5, 1), (6, 1), (6, 2)]
    assert rows(leaks.find_leaks(df, items).select("doc_id", "item_id")) == want
    assert rows(leaks.find_leaks(df.union(df.limit(0)).repartition(5), items.orderBy(F.desc("item_id"))).select("doc_id", "item_id").distinct()) == want
    assert leaks.find_leaks(df.where("false"), items).count() == 0 and leaks.find_leaks(df, items.where("false")).count() == 0


def test_items_that_repeat_are_found(spark):
    """A one-sentence item that stands several times in the set is no standard instruction."""
    one = "The seventh lighthouse keeper buried nine copper kettles beneath the frozen orchard wall before Lent."
    for copies in (1, 2, 3, 5):
        items = [(i, one) for i in range(copies)]
        assert {c[0] for c in leaks.judge(PAD + one + PAD, leaks.build_index(items))} == set(range(copies))
        got = leaks.find_leaks(spark.createDataFrame([(1, PAD + one, "x"), (None, one, "x")], "doc_id long, text string, t string"), spark.createDataFrame(items, "item_id long, text string"))
        assert rows(got.select("doc_id", "item_id")) == [(1, i) for i in range(copies)]
    two = [(i, WORDS_OF[i] + " " + one) for i in range(3)]
    assert leaks.judge(one, leaks.build_index(two)) == []


WORDS_OF = ["Blue otters juggle seventeen pears.", "A tired baker counts wooden spoons.", "Nobody painted the harbour bell."]


def test_the_item_with_other_parameters():
    """Less than half of the item with other names and numbers is found where equal slots stay equal."""
    item = "In March Marlowe took 20 mg of Kestrelin and walked to Oldhaven before noon; then Marlowe counted 37 coins while Kestrelin lay in Oldhaven. " + " ".join(WORDS)
    index = leaks.build_index([(1, item), *ITEMS[1:]])
    part = " ".join(item.split()[:34])
    assert {c[0] for c in leaks.judge(PAD + part.replace("Marlowe", "Hutchins").replace("20", "45").replace("37", "82") + PAD, index)} == {1}
    same = {p: p for p in range(5)}
    anew = lambda other: leaks._filled_anew("ann saw bob call ann".split(), other.split(), same, {0, 2, 4}, {p for p in same if other.split()[p] == "ann saw bob call ann".split()[p]}, leaks.Rule())
    assert anew("eve saw tom call eve") and not anew("eve saw tom call kim") and not anew("eve saw eve call eve") and not anew("eve met tom call eve")


def test_the_join_finds_what_a_search_of_all_pairs_finds(spark):
    documents, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "eval_items"))
    index = leaks.build_index([(r[0], r[1]) for r in items.select("item_id", "text").collect()])
    want = sorted(((d, i) for d, t in documents.select("doc_id", "text").collect() for i, *_ in leaks.judge(t, index)), key=repr)
    assert rows(leaks.find_leaks(documents, items).select("doc_id", "item_id")) == want and len(want) > 10


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_words_never_fail(text):
    made = normal.words(text)
    assert all(w and not w.isspace() for w in made)


def test_planned_mix():
    targets = {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 2), "none": (0.1, 3)}
    sizes = {"a": 1000, "b": 100, "c": 500}
    plan = {p.source: p for p in mixing.plan_mix(targets, sizes)}
    assert abs(plan["a"].weight - 0.5) < 1e-9 and plan["none"].tokens == 0
    assert abs(plan["b"].tokens - 400) < 1e-6 and plan["b"].passes == 4  # the limit of b sets the budget
    more = mixing.plan_mix(targets, sizes, budget=1700)
    assert abs(sum(p.tokens for p in more) - 1700) < 1 and all(p.tokens <= p.available * p.max_repeats * (1 + 1e-9) for p in more)
    flat = mixing.plan_mix(targets, {"a": 10, "b": 10, "c": 10}, least_entropy=math.log(3) - 1e-6)
    assert mixing.entropy({p.source: p.weight for p in flat if p.weight}) >= math.log(3) - 1e-5
    assert all(p.tokens == 0 for p in mixing.plan_mix(targets, {}))


def test_mix(spark):
    random.seed(1)
    docs = [(i, "word " * random.randrange(1, 40), random.choice(["A", " a ", "b", "B", "c", None, "other"])) for i in range(3000)] + [(9000, None, "a"), (9001, "", "a"), (9002, "x " * 50_000, "c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_tokens", F.lit(7)).withColumn("place", F.lit("p"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 1), ("none", 0.1, 1)], "source string, target_share double, max_repeats int")
    made, report = mixing.mix(df, targets)
    got = {r["source"]: r for r in report.collect()}
    for s, t in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(got[s]["weight"] - t) < 1e-9 and got[s]["most_repeats"] <= got[s]["max_repeats"]
    assert abs(got["a"]["share"] - 0.5 / 0.9) < 0.05 and got["none"]["tokens"] == 0
    assert made.groupBy("doc_id", "repeat_no").count().where("count > 1").count() == 0
    whole = mixing.mix(df, targets, budget=20_000.0)[1].agg(F.sum("tokens")).first()[0]
    assert whole <= 20_000 and whole > 19_000
    once = mixing.mix(df, targets, passes=1.0)[1].collect()
    assert 0 < once[0]["exponent"] < 1 and all(r["most_repeats"] <= r["max_repeats"] for r in once)
    assert sum(r["tokens"] for r in once) > sum(r["tokens"] for r in got.values())
    none, empty = mixing.mix(df.where("false"), targets)
    assert none.count() == 0 and empty.agg(F.sum("tokens")).first()[0] == 0


def _pages():
    random.seed(4)
    subject = ["porter", "nurse", "teacher", "visitor", "gardener"]
    verb = ["noticed", "measured", "described", "carried", "forgot"]
    thing = ["swollen ankles", "normal pressure", "a dry cough", "the new tablets", "dull pain"]
    prose = lambda: f"The {random.choice(subject)} has {random.choice(verb)} {random.choice(thing)} and was told that it is not the first time."
    listing = lambda: "\n".join(f"- {random.choice(['Fenvelin', 'Rovtarin', 'Lumzumide'])} {random.randrange(9, 90)} mg, for {random.choice(thing)}" for _ in range(12))
    good = [" ".join(prose() for _ in range(8)) + "\n" + (listing() if i % 2 else prose()) for i in range(300)]
    spam = ["cheap rovtarin " * 40, ", ".join(f"{a} {b}" for a in ("buy", "cheap", "discount") for b in ("knee brace", "joint gel", "slim tea", "rovtarin")), "\n".join(f"http://shop{i}.example/p/{i} buy gel" for i in range(20)), "#cheapgel #buy_brace #discountgel " * 9, prose() + " " + "slim tea coupon knee brace coupon " * 20]
    return good, spam


def test_stuffing(spark):
    good, spam = _pages()
    docs = [*enumerate(good), *enumerate(spam, 1000), *enumerate(spam, 2000), (5000, None), (5001, ""), (5002, "  \n"), (5003, "Short note."), (5004, good[0] * 400), (5005, good[0] + " cheap gel")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("stuffed", F.lit("x"))
    scored = stuffing.score_pages(df)
    assert scored.count() == len(docs)
    assert sorted(r[0] for r in scored.where("stuffed").select("doc_id").collect()) == [*range(1000, 1000 + len(spam)), *range(2000, 2000 + len(spam))]
    assert stuffing.score_pages(df.where("false")).count() == 0


UNSEEN = [
    "L'orchestra provava da settimane una sinfonia che nessuno dei musicisti aveva mai suonato prima. Il direttore, un uomo anziano e paziente, fermava spesso le prove per spiegare ai violini come respirare insieme alla fine di ogni frase.",
    "O barco saiu cedo do porto e os pescadores falavam pouco, porque o mar estava calmo demais para a estação. Quando o sol nasceu atrás das colinas, o mais velho deles começou a cantar uma canção que ninguém conhecia.",
    "Stary zegarmistrz mieszkał na końcu ulicy i codziennie rano otwierał swój warsztat, zanim pierwsze tramwaje ruszyły przez most. Ludzie przynosili mu zegarki, których nikt inny nie potrafił naprawić, a on nigdy się nie spieszył.",
    "De oude molen aan de rand van het dorp stond al jaren stil, maar vorig voorjaar hebben een paar buren besloten om hem weer op te knappen. Elke zaterdag komen ze samen en werken ze tot het donker wordt.",
    "Старый смотритель маяка каждое утро поднимался по узкой лестнице, чтобы проверить лампу и записать погоду в толстую тетрадь. Он жил один, но никогда не скучал, потому что чайки и корабли были его лучшими собеседниками.",
    "Den gamla färjan gick fortfarande över sundet varje timme, trots att bron hade öppnat för flera år sedan. Passagerarna var mest pensionärer och barn som tyckte om att mata måsarna från akterdäcket.",
    "老人每天早上都会到湖边散步，然后坐在一张旧木椅上看书。冬天的时候，湖面结了厚厚的冰，孩子们在上面滑来滑去，笑声传得很远。",
    "The orchestra rehearsed the second movement until midnight, because the oboist kept missing her entrance. Nobody complained; the conductor smiled, tapped his stand and asked the cellos to begin again from the quiet passage before the storm.",
    "Volcanic islands erode quickly once the eruptions cease. Rain carves deep gullies into the soft basalt, waves undercut the cliffs, and within a few million years only a ring of coral marks the place where a mountain used to stand.",
    "Parliament rejected the amendment by a narrow margin after a debate that lasted until dawn. Several ministers had threatened to resign, yet in the end the coalition held together and the budget passed without further changes.",
    "To make the dough, dissolve the yeast in warm milk and let it stand until it foams. Add the flour slowly, knead for ten minutes, cover the bowl with a towel and leave it somewhere warm for an hour.",
    "Compilers translate source code into machine instructions. Most of them first build a tree, then simplify it step by step, and only near the end decide which values live in registers and which must be kept in memory.",
]
FOREIGN_SPAM = [
    "scarpe economiche online, scarpe sconto, comprare scarpe, scarpe offerta Roma, scarpe prezzo basso, scarpe online Milano, scarpe sconto Torino, comprare scarpe online, scarpe offerta, scarpe Napoli",
    "#yoga #cheapyoga #yogamat #yoga_sale #buyyoga #yogaonline #yogashop #yogadeal",
    "plumber London plumber Leeds plumber York plumber Hull plumber Bath plumber Derby plumber Luton plumber Slough plumber Poole plumber Crewe",
]


def test_languages_and_subjects_the_corpus_does_not_hold(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([*enumerate(UNSEEN, -1000), *enumerate(FOREIGN_SPAM, -500)], "doc_id long, text string")
    scored = stuffing.score_pages(documents.unionByName(extra)).where("doc_id < 0")
    assert sorted(r[0] for r in scored.where("stuffed").collect()) == [-500 + i for i in range(len(FOREIGN_SPAM))]
    assert scored.where(F.col("doc_id") < -500).agg(F.max("strange_share")).first()[0] < 0.4


def test_tokens_of_links_and_tags():
    w = lexing.lex(['<a href="http://a.example/x' + "y" * 5000 + '">best gel</a> see www.b.example/y #cheap_gel 12.5 mg, HMR3!', None, "", "<p>l'eau 日本語"])
    assert w.kind.tolist() == [lexing.URL, 0, 0, 0, lexing.URL, lexing.TAG, lexing.NUMBER, 0, lexing.CODE, 0, 0, lexing.IDEOGRAPH, lexing.IDEOGRAPH]
    assert w.text.tolist() == [0] * 9 + [3] * 4 and w.size.tolist()[-4:] == [1, 3, 2, 1] and w.before.tolist()[8] == lexing.COMMA


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60)), max_size=6))
def test_words_of_a_batch_are_those_of_its_texts(texts):
    whole = lexing.lex(texts)
    apart = [lexing.lex([t]) for t in texts]
    assert whole.hash.tolist() == [h for w in apart for h in w.hash.tolist()]
    assert whole.text.tolist() == [i for i, w in enumerate(apart) for _ in range(len(w))]


def test_day_sketches_merge_like_the_whole(spark):
    data = [reading(i, "S", "X1A", float(i % 23) - 4, at=str((ts("2021-01-01") + timedelta(days=i % 40)).date())) for i in range(400)]
    npx, panels = spark.createDataFrame(data, NPX), spark.createDataFrame(PANELS, PANEL)
    days = quantiles.npx_days(npx, panels)
    months = quantiles.npx_percentiles(days, F.date_format("day", "yyyy-MM"))
    assert months.where("scope = 'protein'").agg(F.sum("n_values")).first()[0] == 400


def test_kept_days(spark, tmp_path):
    data = [reading(i, "S", "X1A", float(i % 7), at=str((ts("2021-01-01") + timedelta(days=i % 9)).date())) for i in range(90)]
    npx, panels = spark.createDataFrame(data, NPX), spark.createDataFrame(PANELS, PANEL)
    path = str(tmp_path / "days")
    quantiles.keep_days(path, npx.where("row_id < 50"), panels, 0.01, 0)
    for _ in range(2):  # a delivery that comes again counts once
        days = quantiles.keep_days(path, npx.where("row_id >= 50"), panels, 0.01, 1)
    whole = quantiles.npx_percentiles(quantiles.npx_days(npx, panels, 0.01), error=0.01)
    assert rows(quantiles.npx_percentiles(days, error=0.01)) == rows(whole)
    assert quantiles.keep_days(path, npx.where("false"), panels, 0.02).count() == 0
