"""Records, lists and profile edits on rows with gaps and on empty tables."""

from pyspark.sql import functions as F

from vitrine.operators import curate, profiles, records

PRODUCT = """id long, brand string, domain string, title string, url string, image string, price double, currency string, product_type string, available boolean,
sizes_in_stock array<string>, sizes_offered array<string>, tags array<string>, images array<string>, description string, vendor string, published_at string"""


def test_full_records_with_gaps(spark):
    blank = (1, *[None] * 16)
    whole = (2, "b", "d", "t", "u", "old", 1.0, "EUR", "dress", True, ["S"], ["S"], list("abcdefgh"), list("123456"), "x" * 500, "v", "p")
    rows = {r["id"]: r for r in records.full(spark.createDataFrame([blank, whole], PRODUCT)).collect()}
    assert (rows[1]["brand"], rows[1]["tags"], rows[1]["images"], rows[1]["image"], rows[1]["description"]) == ("", [], [], None, "")
    assert rows[2]["tags"] == list("abcdef") and rows[2]["images"] == list("12345") and rows[2]["image"] == "1" and len(rows[2]["description"]) == 400
    assert "vendor" not in rows[1].asDict()
    assert records.lean(spark.createDataFrame([], PRODUCT)).columns == records.LEAN


def test_lists_of_empty_tables(spark):
    none = spark.createDataFrame([], PRODUCT)
    assert records.meta(none).collect()[0].asDict() == {"items": 0, "brands": 0, "sized": 0, "catalog_brands": []}
    assert records.vendors(none).count() == 0
    spent = records.budget(spark.createDataFrame([], "cost_usd double"), 5.0).collect()[0]
    assert (spent["spent"], spent["remaining"], spent["allowed"]) == (0.0, 5.0, True)
    assert not records.budget(spark.createDataFrame([(9.0,)], "cost_usd double"), 5.0).collect()[0]["allowed"]
    assert not records.budget(spark.createDataFrame([(1.0,)], "cost_usd double"), 5.0, switched_on=False).collect()[0]["allowed"]


def test_vendors_leave_out_the_brand_itself(spark):
    rows = [("A", v) for v in ["a", "A ", "x", "x", "y", "", None]] + [("B", None)]
    got = {r["brand"]: (r["vendors"], r["other_vendors"]) for r in records.vendors(spark.createDataFrame(rows, "brand string, vendor string"), 1).collect()}
    assert got == {"A": (4, ["x"]), "B": (0, [])}


def test_trait_edits_keep_the_last_value_of_each_field(spark):
    own = spark.createDataFrame([("p", 1, "linen", True, False), ("q", 2, "wool", True, False)], "pid string, trait_id long, text string, enabled boolean, user_added boolean")
    new = spark.createDataFrame([("p", 7, "linen"), ("p", 9, "silk"), ("p", 8, "silk"), ("q", 5, "linen")], "pid string, trait_id long, text string")
    added = profiles.traits_added(own, new)
    assert {(r["pid"], r["trait_id"]) for r in added.collect()} == {("p", 1), ("q", 2), ("p", 8), ("q", 5)}
    patches = spark.createDataFrame([(1, 1, False, None), (1, 2, None, "raw linen"), (1, 3, None, None), (99, 4, True, "x")], "trait_id long, n long, enabled boolean, text string")
    got = {r["trait_id"]: (r["text"], r["enabled"], r["encode"]) for r in profiles.traits_patched(added, patches).collect()}
    assert got[1] == ("raw linen", False, True) and got[2] == ("wool", True, False) and 99 not in got
    assert profiles.traits_deleted(added, patches).where("trait_id = 1").count() == 0


def test_defaults_of_a_null_map(spark):
    d = spark.createDataFrame([(1, None), (2, {"a": "1", "z": "9"})], "id long, m map<string,string>")
    m = profiles.with_defaults(F.col("m"), F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("2")))
    got = {r["id"]: (r["m"], r["s"]) for r in d.select("id", m.alias("m"), profiles.settings(m, ("a",)).alias("s")).collect()}
    assert got == {1: ({"a": "0", "b": "2"}, {"a": "0"}), 2: ({"a": "1", "b": "2", "z": "9"}, {"a": "1"})}


def test_settings_that_say_something(spark):
    d = spark.createDataFrame([({"tops": "M", "bottoms": "", "currency": "gbp", "other": "x"},), ({"tops": None, "currency": ""},), (None,)], "m map<string,string>")
    got = [r["s"] for r in d.select(profiles.settings(F.col("m"), ("tops", "bottoms", "dresses", "currency")).alias("s")).collect()]
    assert got == [{"tops": "M", "currency": "GBP"}, {}, None]


def test_a_store_without_a_domain_keeps_its_tags(spark):
    items = spark.createDataFrame([("A",), ("A",), ("B",)], "brand string")
    stores = spark.createDataFrame([("A", None, ["t"]), ("C", "c.com", [])], "name string, domain string, tags array<string>")
    assert {r["name"]: (r["domain"], r["tags"], r["count"]) for r in records.brand_list(items, stores).collect()} == {"A": (None, ["t"], 2), "B": (None, [], 1)}


def test_overview_and_summary_of_gaps(spark):
    schema = "id long, brand string, title string, price double, currency string, available boolean, vendor string, domain string, image string"
    rows = [(3, "A", "x" * 70, 10.0, "USD", True, "a", "late.com", "i3"), (1, "A", None, 2.0, "EUR", True, " V ", "first.com", "i1"), (2, "A", "gone", 20.0, "USD", False, None, "b.com", "i2"), (9, None, "n", None, "USD", False, "", None, None)]
    o = curate.overview(spark.createDataFrame(rows, schema))
    got = {r["brand"]: r for r in o.collect()}
    a, none = got["A"], got[""]
    assert (a["domain"], a["currency"], a["items"], a["median_usd"], a["vendors"], a["other_vendors"], a["preview"], a["sample_titles"]) == ("first.com", "EUR", 3, 15.0, 2, ["V"], ["i1", "i3"], ["", "x" * 60])
    assert (none["domain"], none["items"], none["median_usd"], none["vendors"], none["other_vendors"], none["preview"]) == (None, 1, None, 0, [], [])
    tiers = spark.createDataFrame([("a", "C", "r", None, None, True)], "key string, tier string, reason string, based_in string, evidence string, verified boolean")
    review = spark.createDataFrame([("", "keep")], "key string, decision string")
    traits = spark.createDataFrame([("a", ["linen"])], "key string, traits array<string>")
    view = curate.graded(o, tiers, review, traits)
    assert {r["key"]: (r["tier"], r["reason"], r["based_in"], r["verified"], r["decision"], r["traits"]) for r in view.collect()} == {"a": ("C", "r", "", True, None, ["linen"]), "": (None, "", "", False, "keep", [])}
    assert curate.summary(view).first().asDict() == {"brands": 2, "tiers": {"C": 1, "?": 1}, "decided": 1, "live": 1, "verified": 1}
    assert curate.summary(view.limit(0)).first().asDict() == {"brands": 0, "tiers": {}, "decided": 0, "live": 0, "verified": 0}
