"""Feeds of several profiles in one stream."""

import pytest

from catalake.functions.profiles import FASHION, MARKETPLACE, PROFILES
from catalake.sources.feeds import Limits
from catalake.streaming.routed import RUNS, file_states, loaded, routed_stream, table

F_ROW = dict(vendor_sku="0007", item_name="Shirt", main_category="TOP", brand_name="B", list_price="1200", discount_price="", colour="black",
             size_name="M", quantity="5", description_text="d", image_link="a.jpg")
M_ROW = dict(style_id="s", sku_code="9", title="Bag", category_code="BAG", label="L", regular_price="10", promo_price="", tone="red", fit_size="",
             available_qty="1", details="x", photo="p.jpg")


def text(*rows):
    return "\n".join([",".join(rows[0]), *[",".join(r.values()) for r in rows]]) + "\n"


@pytest.fixture
def world(spark, tmp_path):
    ids = ["sample_fashion_vendor", "sample_marketplace_vendor", "off"]
    state = {"overrides": [("off", None)]}
    registry = spark.createDataFrame([(i, "2") for i in ids], "profile_id string, active_version string")

    def put(folder, name, body):
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / name).write_text(body)

    def run(checkpoint="cp", limits=Limits()):
        overrides = lambda: spark.createDataFrame(state["overrides"], "profile_id string, active_version string")
        routed_stream(spark, str(tmp_path / "in"), lambda: (registry, overrides()), PROFILES, str(tmp_path / "out"),
                      str(tmp_path / checkpoint), limits).awaitTermination()
        states = {r["path"].rsplit("/", 2)[1] + "/" + r["path"].rsplit("/", 1)[1]: (r["status"], r["code"]) for r in file_states(spark, str(tmp_path / "out")).collect()}
        runs = sorted((r["profile_name"], r["profile_version"], r["status"], r["loaded_rows"]) for r in table(spark, str(tmp_path / "out"), "runs", RUNS).collect())
        return states, runs

    return put, run, state, str(tmp_path / "out")


def test_every_file_goes_to_its_profile(spark, world):
    put, run, state, out = world
    put(FASHION.name, "a.csv", text(F_ROW, F_ROW | {"vendor_sku": "", "image_link": "010-1234-5678"}))
    put(FASHION.name, "copy.csv", text(F_ROW, F_ROW | {"vendor_sku": "", "image_link": "010-1234-5678"}))
    put(MARKETPLACE.name, "b.csv", text(M_ROW))
    put(MARKETPLACE.name, "wrong.csv", "some,columns\n1,2\n")
    put("off", "c.csv", text(F_ROW))
    put("nobody", "d.csv", text(F_ROW))
    states, runs = run()
    first = {k: v for k, v in states.items() if not k.startswith(FASHION.name)}
    assert first == {
        f"{MARKETPLACE.name}/b.csv": ("succeeded", None), f"{MARKETPLACE.name}/wrong.csv": ("failed", "missing_columns"),
        "off/c.csv": ("refused", "inactive"), "nobody/d.csv": ("refused", "unsupported"),
    }
    # of two files of one content the first is loaded
    assert states[f"{FASHION.name}/a.csv"] == ("succeeded", None) and f"{FASHION.name}/copy.csv" not in states
    assert runs == [(FASHION.name, "2", "ok", 1), (MARKETPLACE.name, "2", "missing_columns", 0), (MARKETPLACE.name, "2", "ok", 1)]
    assert loaded(spark, out, "staging").count() == 2 and loaded(spark, out, "rejects").first()["source"]["image_link"] == "010-****-5678"
    # a fresh checkpoint sees all files again: nothing is loaded twice
    assert run("cp2") == (states, runs)
    # an override switches versions: the same content is new work for another version
    state["overrides"] = [("off", None), (FASHION.name, "1"), (MARKETPLACE.name, None)]
    states, runs = run("cp3")
    assert (FASHION.name, "1", "ok", 1) in runs and len(runs) == 4
    assert states[f"{MARKETPLACE.name}/b.csv"] == ("succeeded", None)


def test_limits_and_staging_admission(spark, world):
    put, run, _, out = world
    put(FASHION.name, "many.csv", text(F_ROW, F_ROW | {"vendor_sku": "8"}, F_ROW | {"vendor_sku": "9"}))
    states, runs = run(limits=Limits(max_rows=2))
    assert states == {f"{FASHION.name}/many.csv": ("failed", "too_many_rows")} and runs == [(FASHION.name, "2", "too_many_rows", 0)]
    # without the limit the file is loaded after all
    states, runs = run("cp2")
    assert states == {f"{FASHION.name}/many.csv": ("succeeded", None)} and (FASHION.name, "2", "ok", 3) in runs
    assert loaded(spark, out, "staging").count() == 3
