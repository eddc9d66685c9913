"""Scalar functions over blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import equations as e
from vellum.functions import headings as h
from vellum.functions import repair
from vellum.functions import text as t
from vellum.operators import crops, translate, vocabulary
from vellum.queries import derived as d

C = F.col


def x11_legibility(spark, sf_dir):
    text = C("text")
    return d.blocks(spark, sf_dir).select("doc_id", "seq", t.legibility(text).alias("legibility"), t.is_garbage(text).alias("garbage"), t.is_clean(text).alias("clean"), t.is_blank(text).alias("blank"))


X11 = rf"WITH {d.BLOCKS_SQL} SELECT doc_id, seq, {d.legibility('text')} AS legibility, {d.garbage('text')} AS garbage, NOT regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}\x{{FFFD}}]') AS clean, NOT regexp_matches(text, '\S') AS blank FROM blocks"


def f5_preformatted(spark, sf_dir):
    return d.blocks(spark, sf_dir).select("doc_id", "seq", t.is_preformatted(C("text")).alias("rules"), t.is_preformatted(C("text"), pipes=True).alias("pipes"), t.is_decoration(C("line")).alias("decoration"))


_LINES = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))"
_DECO = "(length(trim(x)) >= 4 AND length(regexp_replace(trim(x), '[^*=_#~-]', '', 'g')) / CAST(length(trim(x)) AS DOUBLE) >= 0.8)"
F5 = f"""WITH {d.BLOCKS_SQL} SELECT doc_id, seq,
  len({_LINES}) >= 3 AND len(list_filter({_LINES}, lambda x: {_DECO})) >= 2 AS rules,
  len({_LINES}) >= 3 AND (len(list_filter({_LINES}, lambda x: {_DECO})) >= 2 OR len(list_filter({_LINES}, lambda x: len(string_split(x, '|')) > 2)) >= 2) AS pipes,
  {_DECO.replace('trim(x)', 'trim(line)')} AS decoration FROM blocks"""


def f6_split_tests(spark, sf_dir):
    return d.blocks(spark, sf_dir).select("doc_id", "seq", t.has_split_ligature(C("text")).alias("ligature"), t.has_split_word(C("text")).alias("word"))


F6 = rf"WITH {d.BLOCKS_SQL} SELECT doc_id, seq, regexp_matches(text, '{d.WORD}+ (?:ff|ffi|ffl|fi|fl) {d.WORD}+') AS ligature, regexp_matches(text, '(?:^|[^\p{{L}}\p{{N}}_])[A-Za-z]{{2,}} +[a-z]{{2,}}(?:[^\p{{L}}\p{{N}}_]|$)') AS word FROM blocks"


def x4_clean(spark, sf_dir):
    text = C("text")
    return d.blocks(spark, sf_dir).select("doc_id", "seq", t.clean_reading(text).alias("reading"), t.clean_preformatted(text).alias("laid"), t.escape(text).alias("escaped"), t.drop_rule_pipes(text).alias("no_pipes"), t.refilled(text, C("line")).alias("refilled"))


_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"


def _ligatures(x: str) -> str:
    for n, s in ((2, ""), (27, "ff"), (28, "fi"), (29, "fl"), (30, "ffi"), (31, "ffl")):
        x = f"replace({x}, chr({n}), '{s}')"
    return x


def _reading(x: str) -> str:
    return f"trim({d.gone(d.gone(_ligatures(x), _CONTROL, ' '), r'\s+', ' ')})"


_LAID = d.gone(f"array_to_string(list_transform(string_split(text, chr(10)), lambda x: {d.gone(d.gone(_ligatures('x'), _CONTROL), r'\s+$')}), chr(10))", r"^\n+|\n+$")
X4 = rf"""WITH {d.BLOCKS_SQL} SELECT doc_id, seq, {_reading('text')} AS reading, {_LAID} AS laid, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
  trim({d.gone(d.gone(d.gone('text', r'(^|\s)\|(\s|$)', r'\1 \2'), r'(^|\s)\|(\s|$)', r'\1 \2'), r'\s+', ' ')}) AS no_pipes,
  CASE WHEN {d.garbage('text')} AND length({_reading('line')}) > 0 AND NOT {d.garbage(_reading('line'))} THEN {_reading('line')} ELSE text END AS refilled FROM blocks"""


def x34_headings(spark, sf_dir):
    text = C("text")
    return d.blocks(spark, sf_dir).select("doc_id", "seq", h.is_label(text).alias("label"), h.depth(text, C("level")).alias("depth"), h.kind(text).alias("kind"), h.normalized_title(text).alias("title"), h.anchor(text).alias("anchor"), h.slug(text).alias("slug"), h.alt_text(text).alias("alt"), h.strip_caption(text).alias("uncaptioned"))


_UNCAPTIONED = "CASE WHEN regexp_matches(text, '(?m)^[ ]*[|]') THEN substr(text, strpos(concat(chr(10), text), concat(chr(10), '|'))) ELSE text END"
X34 = rf"""WITH {d.BLOCKS_SQL} SELECT doc_id, seq, regexp_matches(trim(text), '{d.LABEL_SQL}') AS label, {d.depth('text', 'level')} AS depth,
  CASE WHEN starts_with(lower(trim(text)), 'appendix') THEN 'appendix' WHEN starts_with(lower(trim(text)), 'chapter') THEN 'chapter' WHEN starts_with(lower(trim(text)), 'part') THEN 'part' ELSE 'section' END AS kind,
  {d.title('text')} AS title, {d.anchor('text')} AS anchor, {d.slug('text')} AS slug, trim(translate({d.gone('text', r'\s+', ' ')}, '[]', '()')) AS alt, {d.strip(_UNCAPTIONED)} AS uncaptioned FROM blocks"""


def x21_equations(spark, sf_dir):
    text, tokens = C("text"), F.array_join(F.sort_array(e.latex_tokens(C("text"))), " ").alias("tokens")
    scored = d.blocks(spark, sf_dir).select("doc_id", "seq", "line", tokens, e.agreement(text, C("line")).alias("agreement"))
    return scored.select("doc_id", "seq", "tokens", "agreement", e.reading_below(C("agreement"), C("line")).alias("reading"))


_TOKENS = f"list_distinct(regexp_extract_all({d.gone(d.gone(d.gone('text', r'\\(?:text|mathrm|mathbf|mathit|operatorname)\s*\{([^{}]*)\}', r'\1'), r'\\(max|min|exp|log|ln|sin|cos|tan|det|lim|sup|inf|deg|arg|gcd)([^a-zA-Z]|$)', r'\1\2'), r'\\[a-zA-Z]+|[_^{}\s]')}, '[A-Za-z0-9]{{2,}}'))".replace("{{", "{").replace("}}", "}")
X21 = rf"""WITH {d.BLOCKS_SQL}, tokens AS (SELECT *, {_TOKENS} AS said, regexp_extract_all(line, '[A-Za-z0-9]{{2,}}') AS found FROM blocks), scored AS (
  SELECT *, len(list_intersect(said, list_distinct(found))) AS common FROM tokens), done AS (
  SELECT doc_id, seq, line, array_to_string(list_sort(said), ' ') AS tokens, CASE WHEN len(found) >= 3 THEN least(common / CAST(len(list_distinct(found)) AS DOUBLE), CASE WHEN len(said) = 0 THEN 1.0e0 ELSE common / CAST(len(said) AS DOUBLE) END) END AS agreement FROM scored)
SELECT doc_id, seq, tokens, agreement, CASE WHEN agreement < 0.9 THEN trim({d.gone('line', r'\s+', ' ')}) END AS reading FROM done"""


def x26_markup(spark, sf_dir):
    blocks = d.blocks(spark, sf_dir)
    return blocks.select("doc_id", "seq", e.markup(C("text")).alias("markup"), e.unbalanced(F.concat(F.lit("$$\n"), "text", F.lit("\n$$"))).alias("unbalanced"))


X26 = rf"WITH {d.BLOCKS_SQL} SELECT doc_id, seq, {d.markup('text')} AS markup, {d.unbalanced(d.displayed('text'))} AS unbalanced FROM blocks"


def x41_normalized(spark, sf_dir):
    return d.blocks(spark, sf_dir).select("doc_id", "seq", e.normalized(C("text")).alias("normalized"))


def _unwrapped(x: str) -> str:
    for _ in range(3):
        x = d.gone(x, r"\\(?:text|operatorname|mathrm|mathbf|mathit|mathbb|boldsymbol|rm)[\s\x1c-\x1f]*\{?([^{}]*)\}?", r"\1")
    return x


X41 = rf"WITH {d.BLOCKS_SQL} SELECT doc_id, seq, lower({d.gone('replace(replace(' + d.gone(_unwrapped(d.gone('text', r'\\tag\{[^}]*\}')), r'\\(sin|cos|tan|max|min|exp|log|ln)\b', r'\1') + ', concat(chr(92), ' + chr(39) + 'left' + chr(39) + '), ' + chr(39) * 2 + '), concat(chr(92), ' + chr(39) + 'right' + chr(39) + '), ' + chr(39) * 2 + ')', r'\\[,!;:> ]|[\s\x1c-\x1f]+')}) AS normalized FROM blocks"


def t1_vocabulary(spark, sf_dir):
    """The words of all lines. Its SQL has no compatibility folding, which leaves the letters of the tables as they are; a test has others."""
    found = vocabulary.vocabulary(d.lines(spark, sf_dir).select("doc_id", C("line").alias("text")))
    return found.select("doc_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


T1 = rf"WITH lines AS ({d.LINES_SQL}), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '[A-Za-z]+')) AS word FROM lines) SELECT doc_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY encode(word))) AS digest FROM w GROUP BY doc_id"


def x9_repaired(spark, sf_dir):
    """Split ligatures and words joined where the document's own lines have the word: Python, no SQL."""
    docs = d.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    pages = docs.select("doc_id", F.concat("text", F.lit("\ndifferent lowdin")).alias("text"))
    done = vocabulary.repair_words(d.blocks(spark, sf_dir).select("doc_id", "seq", "text"), pages)
    return done.select("doc_id", "seq", repair.normalize(C("text")).alias("text"))


def s7_translated(spark, sf_dir):
    kinds = [*translate.LABELS, "unknown"]
    box = F.struct(*[(C("seq") * k).cast("double").alias(n) for k, n in ((1, "x0"), (2, "y0"), (3, "x1"), (4, "y1"))])
    prov = F.when(C("seq") % 4 != 0, F.array(F.struct((C("seq") + 1).cast("int").alias("page"), box.alias("bbox"))))
    items = d.lines(spark, sf_dir).select("doc_id", "seq", F.concat(F.lit("#/texts/"), "seq").alias("item_id"), F.element_at(F.array(*map(F.lit, kinds)), (C("seq") % len(kinds) + 1).cast("int")).alias("label"), F.col("line").alias("text"), F.lit(1).alias("level"), prov.alias("prov"))
    out = translate.blocks(items)
    turned = translate.flipped(C("bbox"), F.when(C("seq") % 2 == 0, "TOPLEFT").otherwise("BOTTOMLEFT"), F.lit(800.0))
    return out.select("doc_id", "seq", "block_id", "type", "text", "page", turned["y0"].alias("y0"), turned["y1"].alias("y1"))


_KINDS = ", ".join(f"'{v}'" for v in [*translate.LABELS.values(), "other"])
S7 = f"""WITH lines AS ({d.LINES_SQL}) SELECT doc_id, seq, concat('#/texts/', CAST(seq AS STRING)) AS block_id, [{_KINDS}][seq % {len(translate.LABELS) + 1} + 1] AS type, line AS text, CAST(seq + 1 AS INT) AS page,
  CASE WHEN seq % 2 = 0 THEN 800.0e0 - 2 * seq ELSE 2.0e0 * seq END AS y0, CASE WHEN seq % 2 = 0 THEN 800.0e0 - 4 * seq ELSE 4.0e0 * seq END AS y1 FROM lines WHERE seq % 4 <> 0"""


def x39_prompts(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("figure", "table", "equation", "ocr"))), (C("seq") % 4 + 1).cast("int"))
    png = C("line").cast("binary")
    return d.lines(spark, sf_dir).select("doc_id", "seq", crops.prompt(kind, F.when(C("seq") % 2 == 0, "near")).alias("prompt"), F.md5(crops.data_uri(png)).alias("uri"), crops.cache_key(crops.model_for(kind, "m", "o"), kind, png).alias("key"))


_PROMPTS = ", ".join("'" + crops.PROMPTS[k].replace("'", "''") + "'" for k in ("figure", "table", "equation", "ocr"))
X39 = f"""WITH lines AS ({d.LINES_SQL}), k AS (SELECT *, ['figure', 'table', 'equation', 'ocr'][seq % 4 + 1] AS kind FROM lines)
SELECT doc_id, seq, concat([{_PROMPTS}][seq % 4 + 1], CASE WHEN seq % 2 = 0 THEN concat(chr(10), chr(10), 'Context: near') ELSE '' END) AS prompt, md5(concat('data:image/png;base64,', base64(encode(line)))) AS uri,
  concat(CASE WHEN kind IN ('table', 'ocr') THEN 'o' ELSE 'm' END, ':', kind, ':', sha256(line)) AS key FROM k"""


def r4_pixels(spark, sf_dir):
    n = C("doc_id") % 500
    box = F.struct(n.cast("double").alias("x0"), (C("seq") * 10.0).alias("y0"), (n + C("seq") % 60).cast("double").alias("x1"), (C("seq") * 9.0 + 30).alias("y1"))
    p = crops.pixels(box, F.lit(600.0), F.lit(800.0), 144.0, 2.0)
    return d.lines(spark, sf_dir).select("doc_id", "seq", p["left"].alias("l"), p["top"].alias("t"), p["right"].alias("r"), p["bottom"].alias("b"))


R4 = f"""WITH lines AS ({d.LINES_SQL}), b AS (SELECT doc_id, seq, CAST(doc_id % 500 AS DOUBLE) AS x0, seq * 10.0e0 AS y0, CAST(doc_id % 500 + seq % 60 AS DOUBLE) AS x1, seq * 9.0e0 + 30 AS y1 FROM lines),
s AS (SELECT doc_id, seq, greatest(0, least(x0, x1) - 2) AS l, greatest(0, CASE WHEN y0 > y1 THEN 800 - y0 ELSE y0 END - 2) AS t, least(600, greatest(x0, x1) + 2) AS r, least(800, CASE WHEN y0 > y1 THEN 800 - y1 ELSE y1 END + 2) AS b FROM b),
w AS (SELECT *, r - l < 4 OR b - t < 4 AS tiny FROM s)
SELECT doc_id, seq, CAST(trunc(CASE WHEN tiny THEN 0 ELSE l END * 2) AS INT) AS l, CAST(trunc(CASE WHEN tiny THEN 0 ELSE t END * 2) AS INT) AS t, CAST(trunc(CASE WHEN tiny THEN 600 ELSE r END * 2) AS INT) AS r, CAST(trunc(CASE WHEN tiny THEN 800 ELSE b END * 2) AS INT) AS b FROM w"""


QUERIES = {f.__name__: f for f in (x11_legibility, f5_preformatted, f6_split_tests, x4_clean, x34_headings, x21_equations, x26_markup, x41_normalized, t1_vocabulary, x9_repaired, s7_translated, x39_prompts, r4_pixels)}
SQL = {"x11_legibility": X11, "f5_preformatted": F5, "f6_split_tests": F6, "x4_clean": X4, "x34_headings": X34, "x21_equations": X21, "x26_markup": X26, "x41_normalized": X41, "t1_vocabulary": T1, "s7_translated": S7, "x39_prompts": X39, "r4_pixels": R4}
