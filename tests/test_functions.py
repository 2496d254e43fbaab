import hashlib

import pytest
from pyspark.sql import functions as F

from faultlens.functions import diffs as X
from faultlens.functions import logs as L
from faultlens.functions import metrics as M
from faultlens.functions import text as T


@pytest.mark.parametrize("name,parts", [
    ("ScreenshotUtils", ["screenshot", "utils"]), ("logManagementFragment", ["log", "management", "fragment"]),
    ("HTTP2Client", ["http", "2", "client"]), ("audio_focus_helper", ["audio", "focus", "helper"]),
    ("Screenshot", ["screenshot"]), ("", []), ("__", []), ("ABCDef", ["abc", "def"])])
def test_split_identifier(one, name, parts):
    assert one(T.split_identifier(F.col("x")), x=name) == parts


def test_query_terms_keep_reserved_words_and_subwords(one):
    got = one(T.query_terms(F.col("x")), x="NOT the cgeApplyBrightness a1 AND Réaux")
    assert got == ["not", "the", "cgeapplybrightness", "cge", "apply", "brightness", "a1", "and", "reaux"]
    assert one(T.query_terms(F.col("x")), x="!!") == []


def test_index_and_query_terms_agree_on_accents(one):
    assert one(T.index_terms(F.col("x")), x="Réaux, STRASSE-ß") == ["reaux", "strasse", "ß"]


def test_unit_uid_is_sha1_of_nul_joined_identity(one):
    got = one(T.unit_uid(F.lit("r"), F.lit("doc"), F.lit(None).cast("string"), F.lit("n"), F.lit("t")))
    assert got == hashlib.sha1(b"r\0doc\0n\0t").hexdigest()


def test_markdown_sections_drop_preface(one):
    md = "intro\n# One \nbody\n\n## Two\n#no heading\nx\n####### seven"
    got = one(T.markdown_sections(F.col("x")), x=md)
    assert [(s.ord, s.heading, s.body) for s in got] == [(0, "One", "body"), (1, "Two", "#no heading\nx\n####### seven")]


def test_hash_embedding_matches_sha1_buckets(one):
    text, v = "alpha beta beta", [0.0] * 16
    for tok in text.split():
        v[int(hashlib.sha1(tok.encode()).hexdigest(), 16) % 16] += 1
    n = sum(x * x for x in v) ** 0.5
    assert one(T.hash_embedding(F.col("x"), 16), x=text) == pytest.approx([x / n for x in v])
    assert one(T.hash_embedding(F.col("x"), 16), x="") == [0.0] * 16


def test_stable_pick(one):
    want = int.from_bytes(hashlib.sha1(b"case-7").digest()[:8], "big") % 11
    assert one(T.stable_pick(F.col("x"), 11), x="case-7") == want


@pytest.mark.parametrize("path,norm,canon", [
    ("a/b/foo.c", "b/foo.c", "b/foo.c"), ("./x//y.java", "x/y.java", "x/y.java"),
    ("app/src/main/java/org/x/A.java", "app/src/main/java/org/x/A.java", "org/x/A.java"),
    ("src/java/org/x/A.java", "src/java/org/x/A.java", "org/x/A.java"), ("lib/src/x.c", "lib/src/x.c", "x.c")])
def test_paths(one, path, norm, canon):
    assert one(T.norm_path(F.col("x")), x=path) == norm
    assert one(T.canonical_path(F.col("x")), x=path) == canon


def test_anchor_candidates(one):
    got = one(T.anchor_candidates(F.col("x")), x="the label reads \"Border Crossing\" not `BorderService`, JPG or PNG in ScreenUtils v1.2.3 the App")
    assert got == ["Border Crossing", "BorderService", "ScreenUtils", "JPG", "PNG"]


@pytest.mark.parametrize("path,want", [
    ("app/src/main/java/org/x/A.java", ("java", "org.x", "A")), ("jni/cge_image.cpp", ("native", "", "cge_image")),
    ("a/test/java/x/B.java", (None, None, None)), ("README.md", (None, None, None))])
def test_source_path(one, path, want):
    assert tuple(one(T.parse_source_path(F.col("x")), x=path)) == want


def test_symbol_source(one):
    src = "x\n// doc\n * more\nvoid go() {\n a\n b\n c\n d\n}"
    none = F.lit(None).cast("int")
    assert one(T.symbol_source(F.col("s"), F.lit("go"), none, none), s=src) == "// doc\n * more\nvoid go() {\n a\n b\n c"
    assert one(T.symbol_source(F.col("s"), F.lit("missing"), none, none), s=src) == ""
    assert one(T.symbol_source(F.col("s"), F.lit("zz"), F.lit(5), F.lit(6)), s=src) == "a\n b"


@pytest.mark.parametrize("cls,method,key,package,obf", [
    ("org.demo.streams.Writer", "write", "org.demo.streams.Writer.write", "org.demo.streams", False),
    ("Handler2", "process", "Handler2.process", "", False), ("com.x.Foo$$Lambda$3", "run", "com.x.Foo.run", "com.x", True),
    ("com.x.Foo", "access$100", "com.x.Foo.access", "com.x", True), ("com.x.Outer$Inner", "m", "com.x.Outer$Inner.m", "com.x", True),
    ("Java_com_demo_Bridge_nativeInit", "", "com.demo.Bridge.nativeInit", "com.demo", False), ("a.b.c", "d", "a.b.c.d", "a.b", True)])
def test_java_frames(one, cls, method, key, package, obf):
    f = L.java_frame(F.col("c"), F.col("m"), F.lit(""))
    assert one(L.frame_key(f), c=cls, m=method) == key
    got = one(f, c=cls, m=method)
    assert (got.package, got.obfuscated) == (package, obf)


def test_native_frames(one):
    f = L.native_frame(F.col("s"), F.col("y"), F.lit(""))
    assert one(L.frame_key(f), s="/system/lib64/libaudio.so.1.2", y="Stream::start+0x1c") == "Stream::start"
    assert one(f, s="/system/lib64/libaudio.so.1.2", y="Stream::start+0x1c").soname == "libaudio.so"
    assert one(L.frame_key(f), s="libx.so", y="plain_call") == "plain_call"


def test_logcat_line(one):
    got = one(L.logcat_fields(F.col("x")), x="07-05 10:34:07.221  4821  4822 E AndroidRuntime: boom: x")
    assert tuple(got) == ("07-05 10:34:07.221", "4821", "4822", "E", "AndroidRuntime", "boom: x")
    assert tuple(one(L.logcat_fields(F.col("x")), x="free text")) == (None, None, None, None, None, "free text")


@pytest.mark.parametrize("block,kind", [
    ("#00 pc 0000ab libx.so", "native"), ("ANR in com.x", "anr"), ("E/Tag( 12): x", "logcat"), ("  at com.x.Foo.bar(Foo.java:1)", "stacktrace"),
    ("plain words", "other")])
def test_block_kinds(one, block, kind):
    assert one(L.classify_block(F.col("x")), x=block) == kind


def test_signals(one):
    log = ("java.lang.IllegalStateException: x\n  at com.demo.ui.Panel.open(Panel.java:3)\n"
           "#00 pc 00ff /lib/libcart.so (Cart::go+12)")
    s = one(L.signals(F.col("x"), F.lit("")), x=log)
    assert s.classes == ["com.demo.ui.Panel", "java.lang.IllegalStateException"]
    assert s.packages == ["com.demo.ui", "java.lang"] and s.methods == ["open"]
    assert s.symbols == ["Cart::go"] and s.libraries == ["libcart.so"] and s.errors == ["IllegalStateException"]


def test_diff_extraction(one):
    two = "```java\nint x;\n```\n```diff\n--- a/f\n+++ b/f\n@@\n+x\n```"
    assert one(X.unified_diff(F.col("x")), x=two) == "--- a/f\n+++ b/f\n@@\n+x"
    assert one(X.unified_diff(F.col("x")), x="hi\ndiff --git a/f b/f\n+x\n") == "diff --git a/f b/f\n+x"
    assert one(X.unified_diff(F.col("x")), x="nothing") == ""


def test_diff_fields(one):
    d = "+++ b/src/A.java\tx\n@@\n+  call(y);\n+  // other()\n+\n-gone()\n+++ b/src/A.java"
    assert one(X.touched_files(F.col("x")), x=d) == ["src/A.java"]
    assert one(X.code_added_lines(F.col("x")), x=d) == ["  call(y);"]
    assert one(X.references_api(F.col("x"), F.lit("other")), x=d) is True
    assert one(X.references_api_code(F.col("x"), F.lit("other")), x=d) is False
    assert one(X.required_apis(F.col("x")), x=d) == ["call"]


def test_shingles(one):
    patch = "+int veryLongLineNumberOne = 1;\n+}\n+short();\n+import a.b;\n"
    assert one(X.shingles(F.col("x")), x=patch) == ["int veryLongLineNumberOne = 1;", "int veryLongLineNumberOne = 1; short();"]


@pytest.mark.parametrize("text,n", [
    ('```json\n{"targets": [{"file": "a"}, "b", {"why": "x"}], "confidence": "bad"}\n```', 2), ('so {"targets": "x"} ok', 0)])
def test_plans(one, text, n):
    p = one(X.parse_plan(F.col("x")), x=text)
    assert len(p.targets) == n and p.confidence == 0.0 and p.abstain is False


@pytest.mark.parametrize("text", ["", "no braces", "```json\n{\"a\": \n```", "[1, 2]"])
def test_bad_plans_are_null(one, text):
    assert one(X.parse_plan(F.col("x")), x=text) is None


def test_metrics(one):
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    assert one(M.recall_at_k(arr("a", "b", "c"), arr("a", "z"), 2)) == 0.5
    assert one(M.rank_of(arr("b", "a", "c"), F.lit("a"))) == 2
    assert one(M.rank_of(arr("b", "c"), F.lit("a"))) == 0
    lo, hi = M.wilson(F.lit(7), F.lit(10))
    assert 0 <= one(lo) <= 0.7 <= one(hi) <= 1
    lo, hi = M.wilson(F.lit(0), F.lit(0))
    assert (one(lo), one(hi)) == (0.0, 1.0)
    phi = lambda a, ok, c: one(M.reliability(F.lit(a), F.lit(ok), F.lit(c), 1.0))
    assert [phi(True, True, True), phi(True, True, False), phi(False, True, False), phi(False, False, False)] == [1.0, -1.0, 0.0, 1.0]


@pytest.mark.parametrize("name, parts", [("HTTP_client", ["http", "client"]), ("MAX_VALUE", ["max", "value"]), ("org.URL.Parser", ["org", "url", "parser"])])
def test_acronyms_end_with_their_word(one, name, parts):
    assert one(T.split_identifier(F.col("x")), x=name) == parts


def test_tab_indented_comments_are_no_code(one):
    diff = "--- a/x\n+++ b/x\n@@ -1 +1,3 @@\n+\t// useApi(foo)\n+\t\n+real()"
    assert one(X.code_added_lines(F.col("d")), d=diff) == ["real()"]
    assert one(X.references_api_code(F.col("d"), F.lit("useApi")), d=diff) is False


def test_hash_embedding_takes_powers_of_two():
    with pytest.raises(ValueError):
        T.hash_embedding(F.lit("x"), 48)
