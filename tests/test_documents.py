import ipaddress
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpus_spark.fixed_values import ADDRESS_NETWORKS
from corpus_spark.functions import text as tx
from corpus_spark.functions.urls import _network_label, url_check
from corpus_spark.operators import catalogue, searching
from corpus_spark.sources import documents, reference_list


def value(spark, column, **row):
    names = list(row)
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first().v


def test_clean_text_knows_every_whitespace(spark):
    assert value(spark, tx.clean_text(F.col("t")), t=" a\x00b  c\x1d\nd ") == "ab c d"


def test_content_authorities(spark):
    got = value(spark, tx.content_authorities(F.col("t")), t="CONTENT://b.x/1 content:///a/2 content://é/3 content:////q content://b.x/")
    assert got == ["a", "b.x"]


@pytest.mark.parametrize(("build", "want"), [("CP2A.260705.006", "2026-07-05"), ("NDE63H", None), ("X.269999.1", None)])
def test_build_date(spark, build, want):
    assert value(spark, tx.build_date(F.col("b")).cast("string"), b=build) == want


@pytest.mark.parametrize(
    ("url", "fetchable", "blocked"),
    [
        ("http://127.0.0.1/", True, "loopback"), ("http://[::ffff:10.0.0.1]/", True, "private"), ("http://[2002::1]/", True, "6to4"),
        ("https://example.org/a", True, None), ("javascript:x", False, None), ("not a url", False, None), ("http://xn--a.com/", True, None),
    ],
)
def test_url_check(spark, url, fetchable, blocked):
    got = value(spark, url_check(F.col("u")), u=url)
    assert got.blocked == blocked and (got.fetchable is fetchable or "xn--" in url)


def test_page_text_closes_what_is_open(spark):
    html = "<body><nav>menu<p>in</nav>A<!-- no --><div><footer>x</div>B &amp; C<script>var a='</p>'</script><br/>D"
    assert value(spark, documents.page_text(F.col("h")), h=html) == "AB & CD"
    assert value(spark, documents.page_text(F.col("h"), F.lit("text/plain; charset=x")), h="<b>  raw</b>") == "<b> raw</b>"


def test_config_documents_are_guarded(spark):
    docs = [
        ("d", "a.xml", b'<permissions><x><privapp-permissions package="p"/></x><role name="r" static="true" defaultHolders="h; "/></permissions>'),
        ("d", "b.xml", b'<!DocType x [<!ENTITY e "boom">]><permissions><library name="&e;"/></permissions>'),
        ("d", "c.xml", b"<open>"),
        ("d", "e.xml", b"x" * (8 * 1024 * 1024 + 1)),
        ("d", "f.xml", '<?xml version="1.0" encoding="utf-16"?><!DOCTYPE x [<!ENTITY e "boom">]><permissions><library name="&e;"/></permissions>'.encode("utf-16")),
    ]
    got = {tuple(r) for r in documents.harvest_configs(spark.createDataFrame(docs, "device_key string, path string, content binary")).collect()}
    assert got == {
        ("d", "read", "a.xml", None), ("d", "privapp", "p", None), ("d", "role", "r", "h"),
        ("d", "failed", "b.xml", None), ("d", "failed", "c.xml", None), ("d", "failed", "e.xml", None),
        ("d", "failed", "f.xml", None),
    }


def test_reference_list_file(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text(json.dumps({"a": {"list": "Oem", "removal": 3, "description": "d"}, "b": [1], "c": {"list": None}}))
    rows, provenance = reference_list.load_reference_list(spark, str(path))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "Oem", None, "d"), ("b", None, None, None), ("c", None, None, "")]
    assert provenance.first().entry_count == 3
    for bad in ("[]", "{}", "{"):
        path.write_text(bad)
        with pytest.raises(reference_list.ReferenceListError):
            reference_list.load_reference_list(spark, str(path))


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_reference_list_in_several_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "list.json"
    odd = 'x, {y} ["z\\", é'
    listed = {f"p{n}": {"list": "Oem", "description": odd * n} for n in range(12)}
    listed["crossing"] = {"list": "Oem", "description": ", ".join(f"part {n}]" for n in range(250))}
    listed["array"] = [1, {"a": [2, 3]}]
    path.write_text(" " + json.dumps(listed, indent=1, ensure_ascii=False) + "\n")
    assert spark.read.option("lineSep", ",").text(str(path)).rdd.getNumPartitions() >= 4
    rows, provenance = reference_list.load_reference_list(spark, str(path))
    got = {r.package: r.description for r in rows.collect()}
    assert got == {k: v["description"] if isinstance(v, dict) else None for k, v in listed.items()}
    first = provenance.first()
    assert first.entry_count == len(listed) and first.sha256 == hashlib.sha256(path.read_bytes()).hexdigest()


@pytest.mark.parametrize(
    "bad",
    ["", " ", "7", '"a"', '{"a": 1,}', '{"a": 1} {"b": 2}', '{"a": 1} x', '{"a" 1}', '{"a": [1}, "b": 2]}', '{"a": "open}', '{"a": 1, "b"}', 'x{"a": 1}', '{"a": 1, }', '{"a": 1}, {"b": 2}'],
)
def test_malformed_reference_lists_are_refused(spark, tmp_path, bad):
    path = tmp_path / "list.json"
    path.write_text(bad)
    with pytest.raises(reference_list.ReferenceListError):
        reference_list.load_reference_list(spark, str(path))


def test_last_entry_of_a_name_counts(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text('{"a": {"list": "Oem"}, "b": 1, "a": {"list": "Google"}}')
    rows, provenance = reference_list.load_reference_list(spark, str(path))
    assert {r.package: r.list for r in rows.collect()} == {"a": "Google", "b": None} and provenance.first().entry_count == 2


@pytest.mark.parametrize(("path", "want"), [("a/b.apk", True), ("etc/permissions/x.xml", True), ("etc/permissions/x.txt", False), ("roles.xml", True), ("b.apk/x", False)])
def test_artifact_globs(spark, path, want):
    assert value(spark, catalogue.is_artifact(F.col("p")), p=path) is want


def test_slots(spark):
    images = spark.createDataFrame([("d", n) for n in ("system_a", "system_b", "vendor_b", "boot", "boot_a", "_b")], "device string, name string")
    got = {(r.name, r.identity, r.collides) for r in catalogue.resolve_slots(images).collect()}
    assert got == {("system_a", "system", False), ("vendor_b", "vendor", False), ("boot", "boot", True), ("boot_a", "boot", True), ("_b", "_b", False)}


def test_merge_results(spark):
    items = spark.createDataFrame(
        [("p", "web", 0, "u0"), ("p", "web", 1, "u1"), ("p", "web", 2, "u2"), ("p", "discussions", 0, "f0"), ("p", "discussions", 1, "u1")],
        "package string, block string, block_index int, url string",
    )
    display = spark.createDataFrame([("p", 0, "web", 2), ("p", 1, "discussions", None), ("p", 2, "web", 2)], "package string, position int, block string, item int")
    got = [(r.position, r.url) for r in searching.merge_results(items, display, 10).orderBy("position").collect()]
    assert got == [(1, "u2"), (2, "f0"), (3, "u1"), (4, "u0")]


def test_address_labels_equal_the_standard_library():
    chance = random.Random(3)
    hosts = [str(ipaddress.ip_address(chance.getrandbits(32))) for _ in range(4000)]
    for label, blocks in ADDRESS_NETWORKS:
        for block in map(ipaddress.ip_network, blocks):
            top = ipaddress.IPv4Address._ALL_ONES if block.version == 4 else ipaddress.IPv6Address._ALL_ONES
            around = (int(block[0]) - 1, int(block[0]), int(block[-1]), int(block[-1]) + 1)
            hosts += [str(type(block[0])(n)) for n in around if 0 <= n <= top]
    for host in hosts:
        address, got = ipaddress.ip_address(host), _network_label(host)
        if got in ("6to4", "teredo"):
            assert address.sixtofour or address.teredo, host
        elif got is None:
            assert not (address.is_private or address.is_reserved or address.is_multicast), host
        else:
            assert getattr(address, f"is_{got.replace('-', '_')}"), host


def test_page_text_takes_named_references_with_their_semicolon_only(spark):
    pages = {
        "<title>a &amp;&amp</title><p>b</p>": "a &&ampb",
        "<p>x&ampy &copy2; &copy; &#169; &amp": "x&ampy &copy2; © © &amp",
        "<p title='&lt'>&lt;b&gt; AT&T & co</p>": "<b> AT&T & co",
    }
    rows = spark.createDataFrame([(html,) for html in pages], "html string")
    found = rows.select("html", documents.page_text(F.col("html")).alias("text")).collect()
    assert {r["html"]: r["text"] for r in found} == pages
