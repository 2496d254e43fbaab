"""Log-line, stack-frame and issue-body expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultlens import fixed_values as V
from faultlens.functions import text as T

# fixed values: line, frame and block patterns
LOGCAT = (r"^((?:\d{4}-)?\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEFAS])\s+"
          r"([^:]+?):\s?(.*)$")
SIGNAL_FRAME = r"(?U)\bat\s+([a-zA-Z_][\w.]+)\.([A-Za-z_]\w*)\("
SIGNAL_CLASS = r"(?U)\b((?:[a-z][\w]*\.){2,}[A-Z]\w*)"
SIGNAL_NATIVE = r"(?U)#\d+\s+pc\s+[0-9a-fA-F]+\s+\S*?(lib\w+\.so)\s*\(([^)+]+)"
SIGNAL_SO = r"(?U)(lib\w+\.so)"
SIGNAL_ERROR = r"(?U)\b([A-Z]\w+(?:Error|Exception))\b"
JAVA_FRAME = r"(?U)\bat\s+([A-Za-z_][\w.$]+)\.([A-Za-z_<][\w$>]*)\(([^:)]+)(?::(\d+))?\)"
NATIVE_FRAME = r"(?U)#\d+\s+pc\s+[0-9a-fA-F]+\s+(\S+\.so[\w.]*)\s*\(([^)]+)\)"
EXCEPTION = r"(?Um)^\s*((?:[a-z]\w*\.)+[A-Z]\w*(?:Error|Exception))"
BLOCK_FRAME = r"(?Um)^\s*at\s+[\w$.]+\.[\w$<>]+\("
BLOCK_EXCEPTION = r"(?Um)^\s*(?:Caused by:\s*)?(?:[a-z][\w$]*\.)+[A-Z]\w*(?:Exception|Error)\b"
BLOCK_TAG = r"(?Um)^\s*[VDIWEF]/[\w$.\-]+\s*(?:\(\s*\d+\))?\s*:"
BLOCK_TIME = r"(?Um)^\s*\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d{3}\s+\d+\s+\d+\s+[VDIWEF]\s"
BLOCK_NATIVE_FRAME = r"(?Um)^\s*#\d{2}\s+pc\s+[0-9a-fA-F]+\b"
BLOCK_NATIVE = [BLOCK_NATIVE_FRAME, r"(?U)\bsignal\s+\d+\s+\(SIG[A-Z]+\)",
                r"(?Um)^\s*backtrace:\s*$|\bAbort message\b|\bBuild fingerprint\b"]
BLOCK_ANR = [r"(?U)\bANR in\b|Input dispatching timed out"]
BLOCK_LOGCAT = [BLOCK_TAG, BLOCK_TIME, r"(?U)\bE/AndroidRuntime\b", r"(?U)\bFATAL EXCEPTION\b"]
LOG_LINE = [BLOCK_FRAME, BLOCK_TAG, BLOCK_TIME, BLOCK_NATIVE_FRAME]
TEMPLATE_LINE = r"(?Um)^\s*(?:#{1,6}\s.*|-\s*\[[ xX]\].*|<!--.*?-->)\s*$"
FENCE = r"(?ms)^[ \t]*```[^\n]*\n(.*?)^[ \t]*```[ \t]*$"
CRASH = [r"(?Um)^\s*at\s+[\w.$]+\([\w.]+:\d+\)", r"(?U)#\d+\s+pc\s+[0-9a-fA-F]+",
         r"(?U)\b\w+(?:Exception|Error)\b", r"(?Um)^[VDIWEF](?:/\w+|\s+[A-Z]\w*\s*:)",
         r"(?U)\bFATAL EXCEPTION\b", r"(?U)\bE/AndroidRuntime\b"]

FAMILIES = "struct<" + ",".join(f"{f}:array<string>" for f in V.SIGNAL_FAMILIES) + ">"


def any_match(c: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def logcat_fields(raw: Column) -> Column:
    """struct<ts, pid, tid, level, tag, msg>; an unmatched line keeps its text as msg."""
    hit = raw.rlike(LOGCAT)
    names = ["ts", "pid", "tid", "level", "tag", "msg"]
    got = [F.regexp_extract(raw, LOGCAT, i + 1) for i in range(6)]
    got[4] = T.strip(got[4])
    cols = [F.when(hit, g).alias(n) for n, g in zip(names[:5], got[:5])]
    return F.struct(*cols, F.when(hit, got[5]).otherwise(raw).alias("msg"))


def text_lines(c: Column) -> Column:
    """Lines of a text; a trailing newline makes no extra line."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"\n\z", "")
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, "\n"))


def anchor_family(tag: Column, msg: Column) -> Column:
    """Fault family that a line opens, else null."""
    return (F.when(msg.contains("FATAL EXCEPTION"), F.lit("java"))
            .when(((tag == "libc") & msg.contains("Fatal signal")) | msg.rlike(r"\bsignal \d+ \(SIG"), F.lit("native"))
            .when(msg.contains("ANR in"), F.lit("anr")))


def classify_block(c: Column) -> Column:
    """Kind of a log block, first rule that fits."""
    return (F.when(any_match(c, BLOCK_NATIVE), F.lit("native"))
            .when(any_match(c, BLOCK_ANR), F.lit("anr"))
            .when(any_match(c, BLOCK_LOGCAT), F.lit("logcat"))
            .when(any_match(c, [BLOCK_FRAME, BLOCK_EXCEPTION]), F.lit("stacktrace"))
            .otherwise(F.lit("other")))


def has_crash_signature(c: Column) -> Column:
    return any_match(c, CRASH)


def fenced_logs(c: Column) -> Column:
    """array<struct<kind, text>> of the fenced blocks that look like logs."""
    bodies = F.filter(T.groups(F.coalesce(c, F.lit("")), FENCE), lambda b: classify_block(b) != "other")
    return F.transform(bodies, lambda b: F.struct(
        classify_block(b).alias("kind"), F.regexp_replace(b, r"\A\n+|\n+\z", "").alias("text")))


def without_log_fences(c: Column) -> Column:
    """The text with each log-like fence cut out."""
    blocks = F.filter(T.matches(F.coalesce(c, F.lit("")), FENCE),
                      lambda m: classify_block(F.regexp_extract(m, FENCE, 1)) != "other")
    return F.aggregate(blocks, F.coalesce(c, F.lit("")),
                       lambda acc, m: F.concat(acc.substr(F.lit(1), F.instr(acc, m) - 1),
                                               acc.substr(F.instr(acc, m) + F.length(m), F.length(acc))))


def is_log_line(line: Column) -> Column:
    return any_match(line, LOG_LINE)


def strip_template(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, TEMPLATE_LINE, ""), r"\A\s+|\s+\z", "")


def signals(log_text: Column, description: Column) -> Column:
    """Signal families found in logs followed by the description."""
    text = F.concat(F.coalesce(log_text, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))

    def parts(t: Column) -> Column:
        frames = T.matches(t, SIGNAL_FRAME)
        frame_class = F.transform(frames, lambda m: F.regexp_extract(m, SIGNAL_FRAME, 1))
        methods = F.transform(frames, lambda m: F.regexp_extract(m, SIGNAL_FRAME, 2))
        fq = T.groups(t, SIGNAL_CLASS)
        natives = T.matches(t, SIGNAL_NATIVE)
        dotted = F.filter(F.concat(frame_class, fq), lambda x: x.contains("."))
        return F.struct(
            T.distinct_tokens(F.transform(dotted, lambda x: F.regexp_replace(x, r"\.[^.]*\z", ""))).alias("packages"),
            T.distinct_tokens(frame_class, fq).alias("classes"),
            T.distinct_tokens(methods).alias("methods"),
            T.distinct_tokens(F.transform(natives, lambda m: F.trim(F.regexp_extract(m, SIGNAL_NATIVE, 2)))).alias("symbols"),
            T.distinct_tokens(F.transform(natives, lambda m: F.regexp_extract(m, SIGNAL_NATIVE, 1)),
                              T.groups(t, SIGNAL_SO)).alias("libraries"),
            T.distinct_tokens(T.groups(t, SIGNAL_ERROR)).alias("errors"))

    return T.let(text, parts)


def signal_tokens(sig: Column) -> Column:
    """Distinct tokens of all families in search order."""
    return T.distinct_tokens(*[sig[f] for f in V.TOKEN_ORDER])


def java_frame(fq_class: Column, method: Column, raw: Column) -> Column:
    """Normalised Java frame struct; a lone JNI name is unpacked."""
    clean = F.regexp_replace(F.trim(F.coalesce(method, F.lit(""))), r"\$\d+$", "")
    jni = r"(?U)^Java_(.+)_([A-Za-z_]\w*)$"
    is_jni = fq_class.rlike(jni) & (clean == "")
    name = F.trim(F.when(is_jni, F.replace(F.regexp_extract(fq_class, jni, 1), F.lit("_"), F.lit("."))).otherwise(fq_class))
    called = F.when(is_jni, F.regexp_extract(fq_class, jni, 2)).otherwise(clean)
    package = F.when(name.contains("."), F.regexp_replace(name, r"\.[^.]*\z", "")).otherwise(F.lit(""))
    klass = F.regexp_replace(F.regexp_replace(F.substring_index(name, ".", -1), r"\$\$Lambda\$\d+$", ""), r"\$\d+$", "")
    segments = F.concat(F.split(package, r"\."), F.array(klass))
    return F.struct(package.alias("package"), klass.alias("klass"), called.alias("method"),
                    F.lit("").alias("soname"), F.lit("").alias("symbol"),
                    F.exists(segments, lambda s: s.rlike("^[a-z]$")).alias("obfuscated"), raw.alias("raw"))


def native_frame(so_path: Column, symbol: Column, raw: Column) -> Column:
    """Normalised native frame struct; soname version and symbol offset are dropped."""
    base = T.basename(so_path)
    short = F.regexp_extract(base, r"(?U)^(lib[\w.+-]*?\.so)", 1)
    sym = F.trim(F.get(F.split(F.trim(symbol), r"\+0x|\+\d", 2), F.lit(0)))
    klass = F.when(sym.contains("::"), F.regexp_replace(sym, r"::(?:(?!::).)*\z", "")).otherwise(F.lit(""))
    return F.struct(F.lit("").alias("package"), klass.alias("klass"), F.substring_index(sym, "::", -1).alias("method"),
                    F.when(short != "", short).otherwise(base).alias("soname"), sym.alias("symbol"),
                    F.lit(False).alias("obfuscated"), raw.alias("raw"))


def frame_key(f: Column) -> Column:
    """The comparison key of a frame."""
    native = F.when(f["klass"] != "", F.concat(f["klass"], F.lit("::"), f["method"])).otherwise(f["method"])
    base = F.when(f["method"] != "", F.concat(f["klass"], F.lit("."), f["method"])).otherwise(f["klass"])
    java = F.when(f["package"] != "", F.concat(f["package"], F.lit("."), base)).otherwise(base)
    return F.when((f["soname"] != "") | (f["symbol"] != ""), native).otherwise(java)


def is_framework(f: Column) -> Column:
    key = F.concat(F.when(f["package"] != "", F.concat(f["package"], F.lit("."))).otherwise(F.lit("")), f["klass"])
    return F.when(f["soname"] != "", f["soname"].isin(*V.FRAMEWORK_SONAMES)).otherwise(
        T.starts_any(key, V.FRAMEWORK_PREFIXES))


def frames(block: Column) -> Column:
    """Frames of a crash block: the Java ones first, then the native ones, each in text order."""
    java = F.transform(T.matches(block, JAVA_FRAME), lambda m: java_frame(
        F.regexp_extract(m, JAVA_FRAME, 1), F.regexp_extract(m, JAVA_FRAME, 2), m))
    native = F.transform(T.matches(block, NATIVE_FRAME), lambda m: native_frame(
        F.regexp_extract(m, NATIVE_FRAME, 1), F.regexp_extract(m, NATIVE_FRAME, 2), m))
    return F.concat(java, native)


def blame(all_frames: Column) -> Column:
    """struct<top, confidence>: first frame outside the framework, else the first frame as LOW."""
    def pick(fs: Column) -> Column:
        owner = F.get(F.filter(fs, lambda f: ~is_framework(f)), F.lit(0))
        confidence = (F.when(owner.isNull(), F.lit("LOW")).when(owner["obfuscated"], F.lit("MEDIUM"))
                      .otherwise(F.lit("HIGH")))
        return F.struct(F.coalesce(owner, F.get(fs, F.lit(0))).alias("top"), confidence.alias("confidence"))

    return T.let(all_frames, pick)


def file_hint(top: Column) -> Column:
    return F.nullif(F.regexp_extract(top["raw"], JAVA_FRAME, 3), F.lit(""))


def fault_signals(all_frames: Column, top: Column, exception: Column) -> Column:
    """Signals of the fault site only: frames outside the framework plus the blamed frame."""
    def build(owners: Column) -> Column:
        def take(field: str) -> Column:
            return T.distinct_tokens(F.transform(owners, lambda f: f[field]))
        return F.struct(
            take("package").alias("packages"), take("klass").alias("classes"), take("method").alias("methods"),
            take("symbol").alias("symbols"), take("soname").alias("libraries"),
            T.distinct_tokens(F.array(F.substring_index(F.coalesce(exception, F.lit("")), ".", -1))).alias("errors"))

    own = F.filter(all_frames, lambda f: ~is_framework(f))
    owners = F.when(top.isNotNull() & is_framework(top), F.concat(F.array(top), own)).otherwise(own)
    return T.let(owners, build)
