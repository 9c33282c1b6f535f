"""Problem 5: clean text out of HTML, Markdown, wiki and LaTeX, keeping its structure.

Deducing a template from tokens with equal occurrence vectors over pages of one host (the method
named for this problem) is built here too: ``template_classes`` finds the classes, ``slots_of`` nests
those valid on a page and ``template_slots`` gives what stands in the slots. It cannot give what is
asked: on the test tables its slots hold 27 per cent of the structural elements and do not tell their
kinds, as single delimiters (# - == \\item) have no partner, entities and escapes need the format's
own rules, and a text's elements would change with the other pages at hand (figures in the README). So
the elements and clean texts come from a scanner for each format instead.

The format is found from the text, the suffix of the path deciding only between equals. A text in
a .txt file holds no markup.

Defined results: null, empty and blank texts, and texts without markup, have no elements and come out
as they are; elements cut off by the end of an excerpt run to the end; repeated rows give repeated
elements only once per row; a null id is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Element = tuple[str, str]
_squeeze = regex.compile(r"\s+").sub


def squeeze(s: str) -> str:
    """Runs of whitespace made one blank, trimmed."""
    return _squeeze(" ", s).strip()


# ---------------------------------------------------------------- format

_SIGNS = {
    "html": regex.compile(r"</?(?:p|h[1-6]|ul|ol|li|pre|div|html|body|table|tr|td|span|script|style)\b[^<>]*>", regex.I),
    "tex": regex.compile(r"\\(?:documentclass|begin|end|(?:sub){0,2}section|item|textbf|emph|href|cite|label|vspace|newpage|usepackage|chapter|paragraph)\b"),
    "wiki": regex.compile(r"(?m)^={2,6}[^=\n].*?={2,6}[^\S\n]*$|\[\[[^\[\]\n]+\]\]|'''|\{\{[^{}\n]+\}\}|</?(?:math|ref|nowiki|syntaxhighlight|pre)\b[^<>]*>|^__[A-Z]+__$|\[https?://[^\s\]]+ [^\]\n]+\]"),
    "md": regex.compile(r"(?m)^#{1,6}[ \t]+\S|^(?:```|~~~)|^\$\$|^[ ]{0,3}(?:[-*+]|\d{1,9}[.)])[ \t]+\S|\]\([^()\s]*\)|\*\*\S|^>[ \t]|^[^\s].*\n(?:={3,}|-{3,})[^\S\n]*$|\$\S[^$\n]*\\\S[^$\n]*\$"),
}
_SUFFIX = {"html": "html", "htm": "html", "md": "md", "markdown": "md", "wiki": "wiki", "tex": "tex"}


def suffix(path: str | None) -> str:
    return (path or "").strip().lower().rpartition(".")[2] if "." in (path or "") else ""


def markup_format(text: str, path: str | None) -> str:
    """html, md, wiki, tex or '' for none."""
    end = suffix(path)
    if end == "txt":
        return ""
    n = {k: len(p.findall(text)) for k, p in _SIGNS.items()}
    # delimiters that two formats share count for the one that otherwise shows itself
    if n["wiki"] and not n["html"] - len(regex.findall(r"</?pre\b[^<>]*>", text, regex.I)):
        n["html"] = 0
    named = _SUFFIX.get(end)
    order = [named] if named else []
    order += [k for k in ("tex", "html", "wiki", "md") if k != named]
    strong = {k: n[k] for k in ("tex", "html", "wiki")}
    best = max(strong, key=lambda k: strong[k])
    if strong[best] and (named != "md" or strong[best] >= n["md"]):
        if named in strong and strong[named] == strong[best]:
            return named
        if named == "md" and n["md"] and strong[best] <= n["md"]:
            return "md"
        return best
    return "md" if n["md"] else ""


# ---------------------------------------------------------------- inline text

_MD_LINK = regex.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+[\"'][^\"']*[\"'])?\)")
_MD_EMPH = [regex.compile(p) for p in (r"\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*", r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"(?<![\p{L}\p{N}*])\*(?=[^\s*])([^*]*?)(?<=\S)\*(?![\p{L}\p{N}*])", r"(?<![\p{L}\p{N}_])__(?=\S)(.+?)(?<=\S)__(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_])_(?=[^\s_])([^_]*?)(?<=\S)_(?![\p{L}\p{N}_])", r"~~(?=\S)(.+?)~~", r"`+([^`]+)`+")]
_TAG = regex.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", regex.S)


def md_text(s: str) -> str:
    kept: list[str] = []

    def keep(m: regex.Match) -> str:
        kept.append(m.group(1))
        return f"\ue000{len(kept) - 1}\ue001"

    s = regex.sub(r"\\([!-/:-@\[-`{-~])", keep, s)  # an escaped mark is the mark itself
    s = _MD_LINK.sub(r"\1", s)
    s = regex.sub(r"<((?:https?|mailto):[^<>\s]+)>", r"\1", s)
    for p in _MD_EMPH:
        s = p.sub(r"\1", s)
    s = html.unescape(_TAG.sub("", s))
    return squeeze(regex.sub("\ue000(\\d+)\ue001", lambda m: kept[int(m.group(1))], s))


def html_text(s: str) -> str:
    s = regex.sub(r"(?is)<(script|style)\b.*?(?:</\1\s*>|\Z)", " ", s)
    s = regex.sub(r"(?i)<br\b[^<>]*>", " ", s)
    return squeeze(html.unescape(_TAG.sub("", s)))


def wiki_text(s: str) -> str:
    s = regex.sub(r"(?is)<!--.*?-->|<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", "", s)
    while True:
        t = regex.sub(r"\{\{[^{}]*\}\}", "", s)
        if t == s:
            break
        s = t
    s = regex.sub(r"\[\[(?:Category|File|Image|Kategorie|Datei):[^\[\]]*\]\]", "", s, flags=regex.I)
    s = regex.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", s)
    s = regex.sub(r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]]*)\]", r"\1", s)
    s = regex.sub(r"\[(?:https?|ftp)://[^\s\]]+\]", "", s)
    s = regex.sub(r"'{2,5}", "", s)
    return squeeze(html.unescape(_TAG.sub("", s)))


#: a group in braces, braces within to any depth; patterns that use it end on ``_WITHIN``
_BRACED = r"\{((?:[^{}\\]|\\.|(?&within))*+)\}"
_WITHIN = r"(?(DEFINE)(?P<within>\{(?:[^{}\\]|\\.|(?&within))*+\}))"


def tex_text(s: str) -> str:
    s = regex.sub(r"(?m)(?<!\\)%.*$", "", s)
    s = regex.sub(r"~?\\(?:cite[a-z]*|label|ref|eqref|footnote|index|vspace|hspace)\*?(?:\[[^\]]*\])?" + _BRACED + _WITHIN, "", s)
    s = regex.sub(r"\\href" + _BRACED + _BRACED + _WITHIN, r"\2", s)
    while True:
        t = regex.sub(r"\\(?:emph|text\w*|underline|mbox|url|textsc)\s*" + _BRACED + _WITHIN, r"\1", s)
        if t == s:
            break
        s = t
    s = regex.sub(r"\\(?:newpage|noindent|par|centering|clearpage|maketitle|bigskip|medskip|smallskip)\b", " ", s)
    s = s.replace("\\\\", " ").replace("~", " ").replace("``", "“").replace("''", "”")
    s = regex.sub(r"\\textbackslash(?:\{\})?", r"\\", s)
    s = regex.sub(r"\\([&%$#_{}])", r"\1", s)
    return squeeze(s)


# ---------------------------------------------------------------- scanners


class Found:
    """Elements of a text in order, and the clean text built beside them."""

    def __init__(self) -> None:
        self.elements: list[Element] = []
        self.blocks: list[str] = []

    def add(self, kind: str, body: str, shown: str | None = None) -> None:
        if kind in ("code", "formula"):
            body = squeeze(body)
        if body:
            self.elements.append((kind, body))
            if shown is not None:
                self.blocks.append(shown)


_MD_FENCE = regex.compile(r"^ {0,3}(`{3,}|~{3,})[^`\n]*$")
_MD_ATX = regex.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_MD_ITEM = regex.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_MD_RULE = regex.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})$")
_MD_MATH = regex.compile(r"(?<![\\$\p{L}\p{N}])\$(?=[^\s$])((?:\\.|[^$\\\n])+?)(?<=[^\s\\])\$(?![\p{N}$])|\\\((.+?)\\\)")


def scan_md(text: str) -> Found:
    out = Found()
    lines = text.split("\n")
    i, para = 0, []

    def inline(s: str) -> str:
        s = regex.sub(r"`[^`\n]+`", " ", s)
        for m in _MD_MATH.finditer(s):
            out.add("formula", m.group(1) or m.group(2))
        return s

    def flush() -> None:
        if para:
            inline("\n".join(para))
            shown = md_text(regex.sub(r"(?m)^ {0,3}> ?", "", "\n".join(para)))
            if shown:
                out.blocks.append(shown)
            para.clear()

    while i < len(lines):
        line = lines[i]
        fence = _MD_FENCE.match(line)
        if fence:
            flush()
            mark = fence.group(1)
            body, i = [], i + 1
            while i < len(lines) and not regex.match(rf"^ {{0,3}}{regex.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                body.append(lines[i])
                i += 1
            out.add("code", "\n".join(body), "\n".join(body))
        elif line.strip() == "$$":
            flush()
            body, i = [], i + 1
            while i < len(lines) and lines[i].strip() != "$$":
                body.append(lines[i])
                i += 1
            out.add("formula", "\n".join(body), "$$" + squeeze("\n".join(body)) + "$$")
        elif (m := regex.match(r"^\s*\$\$(.+?)\$\$\s*$", line)) or (m := regex.match(r"^\s*\\\[(.+?)\\\]\s*$", line)):
            flush()
            out.add("formula", m.group(1), "$$" + squeeze(m.group(1)) + "$$")
        elif (m := _MD_ATX.match(line)) and m.group(2):
            flush()
            inline(m.group(2))
            body = md_text(m.group(2))
            out.add("heading", body, "#" * len(m.group(1)) + " " + body)
        elif para and len(para) == 1 and regex.match(r"^ {0,3}(?:=+|-{2,})[ \t]*$", line):
            title = para.pop()
            inline(title)
            body = md_text(title)
            out.add("heading", body, ("#" if line.strip()[0] == "=" else "##") + " " + body)
        elif _MD_RULE.match(line):
            flush()
        elif (m := _MD_ITEM.match(line)) and (m.group(2).strip()) and (len(m.group(1)) < 4 or (out.elements and out.elements[-1][0] == "list_item")):
            flush()
            body = [m.group(2)]
            while i + 1 < len(lines) and lines[i + 1].strip() and lines[i + 1].startswith((" ", "\t")) and not _MD_ITEM.match(lines[i + 1]):
                i += 1
                body.append(lines[i].strip())
            inline("\n".join(body))
            plain = md_text("\n".join(body))
            out.add("list_item", plain, "- " + plain)
        elif line.startswith(("    ", "\t")) and line.strip() and not para:
            body = [line]
            while i + 1 < len(lines) and (lines[i + 1].startswith(("    ", "\t")) or not lines[i + 1].strip()):
                i += 1
                body.append(lines[i])
            body = "\n".join(b[4:] if b.startswith("    ") else b.lstrip("\t") for b in body).rstrip()
            out.add("code", body, body)
        elif not line.strip():
            flush()
        else:
            para.append(line)
        i += 1
    flush()
    return out


_HTML_BLOCK = regex.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<drop>script|style|head|template)\b[^<>]*>.*?(?:</(?P=drop)\s*>|\Z)"
    r"|<pre\b[^<>]*>(?P<pre>.*?)(?:</pre\s*>|\Z)"
    r"|<h(?P<level>[1-6])\b[^<>]*>(?P<head>.*?)(?:</h[1-6]\s*>|(?=<(?:p|h[1-6]|ul|ol|pre|div)\b)|\Z)"
    r"|<li\b[^<>]*>(?P<item>.*?)(?:</li\s*>|(?=<(?:li|ul|ol|/ul|/ol|h[1-6]|p)\b)|\Z)",
    regex.I | regex.S,
)
_HTML_MATH = regex.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]|<math\b[^<>]*>(.*?)</math\s*>|\$\$(.+?)\$\$", regex.I | regex.S)


def scan_html(text: str) -> Found:
    out = Found()

    def math(s: str) -> None:
        for m in _HTML_MATH.finditer(s):
            out.add("formula", html.unescape(_TAG.sub("", next(g for g in m.groups() if g is not None))))

    def prose(s: str) -> None:
        math(s)
        for part in regex.split(r"(?i)<(?:p|div|br|/p|/div|blockquote|tr|table)\b[^<>]*>", s):
            shown = html_text(part)
            if shown:
                out.blocks.append(shown)

    at = 0
    for m in _HTML_BLOCK.finditer(text):
        prose(text[at : m.start()])
        at = m.end()
        if m.group("pre") is not None:
            body = html.unescape(_TAG.sub("", m.group("pre")))
            out.add("code", body, body.strip("\n"))
        elif m.group("head") is not None:
            math(m.group("head"))
            body = html_text(m.group("head"))
            out.add("heading", body, "#" * int(m.group("level")) + " " + body)
        elif m.group("item") is not None:
            math(m.group("item"))
            body = html_text(m.group("item"))
            out.add("list_item", body, "- " + body)
    prose(text[at:])
    return out


_WIKI_BLOCK = regex.compile(r"<!--.*?(?:-->|\Z)|<(?P<tag>pre|syntaxhighlight|source)\b[^<>]*(?<!/)>(?P<code>.*?)(?:</(?P=tag)\s*>|\Z)", regex.I | regex.S)
_WIKI_MATH = regex.compile(r"<math\b[^<>]*>(.*?)</math\s*>", regex.I | regex.S)


def scan_wiki(text: str) -> Found:
    out = Found()

    def lines(s: str) -> None:
        for line in s.split("\n"):
            for m in _WIKI_MATH.finditer(line):
                out.add("formula", html.unescape(m.group(1)))
            if m := regex.match(r"^(={1,6})(?!=)\s*(.*?\S)\s*(?<!=)\1\s*$", line):
                body = wiki_text(m.group(2))
                out.add("heading", body, "#" * len(m.group(1)) + " " + body)
            elif m := regex.match(r"^[*#;]+[:*#;]*\s*(.*)$", line):
                body = wiki_text(m.group(1))
                out.add("list_item", body, "- " + body)
            elif not regex.match(r"^__[A-Z]+__\s*$", line):
                shown = wiki_text(line.lstrip(":"))
                if shown:
                    out.blocks.append(shown)

    at = 0
    for m in _WIKI_BLOCK.finditer(text):
        lines(text[at : m.start()])
        at = m.end()
        if m.group("code") is not None:
            body = html.unescape(m.group("code"))
            out.add("code", body, body.strip("\n"))
    lines(text[at:])
    return out


_TEX_BLOCK = regex.compile(
    r"\\begin\{(?P<env>lstlisting|verbatim\*?|minted|Verbatim)\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?(?P<code>.*?)(?:\\end\{(?P=env)\}|\Z)"
    r"|\\begin\{(?P<menv>equation\*?|align\*?|displaymath|math|gather\*?|eqnarray\*?)\}(?P<display>.*?)(?:\\end\{(?P=menv)\}|\Z)"
    r"|(?<!\\)\\\[(?P<bracket>.*?)(?:\\\]|\Z)|(?<!\\)\$\$(?P<dollars>.*?)\$\$"
    r"|\\(?P<level>part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]\n]*\])?" + _BRACED.replace("((", "(?P<head>(", 1)
    + r"|\\item\b(?:\[[^\]\n]*\])?(?P<item>.*?)(?=\\item\b|\\end\{|\\begin\{|\\(?:sub){0,2}section\b|\n\s*\n|\Z)" + _WITHIN,
    regex.S,
)
_TEX_MATH = regex.compile(r"(?<!\\)\$(?=[^\s$])((?:\\.|[^$\\])+?)(?<!\s)\$|(?<!\\)\\\((.+?)\\\)", regex.S)


def scan_tex(text: str) -> Found:
    out = Found()

    def math(s: str) -> None:
        for m in _TEX_MATH.finditer(regex.sub(r"(?m)(?<!\\)%.*$", "", s)):
            out.add("formula", m.group(1) or m.group(2))

    def prose(s: str) -> None:
        math(s)
        s = regex.sub(r"\\(?:documentclass|usepackage|begin|end|label|vspace|bibliography\w*)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}", "", s)
        for part in regex.split(r"\n\s*\n", s):
            shown = tex_text(part)
            if shown:
                out.blocks.append(shown)

    at = 0
    for m in _TEX_BLOCK.finditer(text):
        prose(text[at : m.start()])
        at = m.end()
        if m.group("code") is not None:
            out.add("code", m.group("code"), m.group("code").strip("\n"))
        elif m.group("head") is not None:
            math(m.group("head"))
            body = tex_text(m.group("head"))
            out.add("heading", body, "#" * (1 + m.group("level").count("sub")) + " " + body)
        elif m.group("item") is not None:
            math(m.group("item"))
            body = tex_text(m.group("item"))
            out.add("list_item", body, "- " + body)
        else:
            body = next((m.group(g) for g in ("display", "bracket", "dollars") if m.group(g) is not None), "")
            body = regex.sub(r"\\label\{[^{}]*\}", "", body)
            out.add("formula", body, "$$" + squeeze(body) + "$$")
    prose(text[at:])
    return out


SCANNERS = {"md": scan_md, "html": scan_html, "wiki": scan_wiki, "tex": scan_tex}


def read(text: str | None, path: str | None) -> Found:
    """Elements and clean text of one text."""
    kind = markup_format(text, path) if text and not text.isspace() else ""
    if not kind:
        out = Found()
        if text is not None:
            out.blocks.append(text)
        return out
    return SCANNERS[kind](text.replace("\r\n", "\n").replace("\r", "\n"))


def _mapped(df: DataFrame, key: str, text: str, path: str, fields: list[str], rows) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, cols = [], [[] for _ in fields]
            for k, t, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for row in rows(t, p):
                    keys.append(k)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *[pa.array(c, pa.string()) for c in cols]], names=[key, *fields])

    src = df.select(F.col(key), F.col(text).cast("string").alias("text_"), F.col(path).cast("string").alias("path_"))
    return src.mapInArrow(run, ", ".join([f"`{key}` {df.schema[key].dataType.simpleString()}"] + [f"{f} string" for f in fields]))


def elements(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key, kind and body of every structural element, equal ones of a text once."""
    return _mapped(df, key, text, path, ["kind", "body"], lambda t, p: dict.fromkeys(read(t, p).elements))


def clean_texts(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key and clean text: headings marked with #, items with -, code and formulas as written."""
    return _mapped(df, key, text, path, ["clean"], lambda t, p: [(None if t is None else "\n\n".join(read(t, p).blocks),)])


# ---------------------------------------------------------------- the method named: templates by equivalence classes

_DELIMITER = regex.compile(r"</?[A-Za-z][A-Za-z0-9]*\b[^<>]*>|\\(?:begin|end)\{[a-z]+\*?\}|\\[A-Za-z]+|\\[()\[\]]|(?m)^(?:#{1,6}|[-*+])(?=\s)|={2,6}|```|~~~|\$\$|\$|\*\*|\'{2,3}|\{\{|\}\}|\[\[|\]\]|[{}]")
_TAG_NAME = regex.compile(r"</?[A-Za-z][A-Za-z0-9]*")


def _delimiters(text: str) -> list[tuple[str, int, int]]:
    """Token, start and end of every delimiter; a tag without its attributes."""
    found = []
    for m in _DELIMITER.finditer(text):
        token = m.group()
        found.append((_TAG_NAME.match(token).group().lower() if token[0] == "<" else token, m.start(), m.end()))
    return found


def template_classes(df: DataFrame, key: str, text: str, host) -> DataFrame:
    """host, marks, pages and uses: delimiters with one occurrence vector over the pages of a host."""
    classes = ordered_classes(df, key, text, host).filter("size(marks) > 1")
    return classes.select("host", F.concat_ws(" ", F.sort_array("marks")).alias("marks"), "pages", "uses")


def ordered_classes(df: DataFrame, key: str, text: str, host) -> DataFrame:
    """host, marks in their order on the pages, pages and uses of the classes of one occurrence vector.

    A vector is kept as a sum of hashes of (page, times), so it needs no page to be gathered; equal sums
    and counts put delimiters in one class. A delimiter alone is a class if it comes in pairs on every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, pages, marks, times, places = [], [], [], [], []
            for k, h, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen: dict[str, list[int]] = {}
                for i, (mark, _, _) in enumerate(_delimiters(t or "")):
                    seen.setdefault(mark, []).append(i)
                for mark, at in seen.items():
                    hosts.append(h), pages.append(k), marks.append(mark), times.append(len(at)), places.append(sum(at) / len(at))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(marks, pa.string()), pa.array(times, pa.int64()), pa.array(places, pa.float64())], names=["host", "page", "mark", "n", "place"])

    src = df.select(F.xxhash64(F.col(key), F.col(text)).alias("page"), host.cast("string").alias("host"), F.col(text).cast("string").alias("text_"))
    uses = src.mapInArrow(run, "host string, page bigint, mark string, n bigint, place double")
    vector = F.sum(F.xxhash64("page", "n").cast("decimal(20,0)"))
    per_mark = uses.groupBy("host", "mark").agg(vector.alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("uses"), F.max(F.col("n") % 2).alias("odd"), F.sum("place").alias("place"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "mark"))), lambda x: x["mark"])
    classes = per_mark.groupBy("host", "vector", "pages", "uses").agg(ordered.alias("marks"), F.max("odd").alias("odd"))
    return classes.filter("size(marks) > 1 OR odd = 0").select("host", "marks", "pages", "uses")


def slots_of(text: str, classes: list[list[str]]) -> list[tuple[str, int, str]]:
    """Class, depth and content of every slot: what stands between neighbouring marks of one class, classes nested as they close.

    A class is valid on a page if its marks follow each other there in order; of others nothing is taken."""
    of = {m: (i, j) for i, c in enumerate(classes) for j, m in enumerate(c)}
    found, stack, due = [], [], {}
    broken = set()
    for mark, start, end in _delimiters(text):
        if mark not in of:
            continue
        i, j = of[mark]
        size = max(2, len(classes[i]))
        at = due.get(i, 0)
        if len(classes[i]) > 1 and j != at:
            broken.add(i)
        if at:
            while stack and stack[-1][0] != i:
                stack.pop()
            if stack:
                found.append((i, len(stack), text[stack.pop()[1] : start]))
        due[i] = (at + 1) % size
        if due[i]:
            stack.append((i, end))
    return [(" ".join(classes[i]), depth, body) for i, depth, body in found if i not in broken]


def template_slots(df: DataFrame, key: str, text: str, host) -> DataFrame:
    """key, marks, depth and body of every slot of the template deduced for the host of each page.

    The classes of a host (marks are few kinds) are brought to its pages by a join on the host."""
    classes = ordered_classes(df, key, text, host).groupBy("host").agg(F.sort_array(F.collect_list("marks")).alias("classes_"))
    src = df.select(F.col(key), F.col(text).cast("string").alias("text_"), host.cast("string").alias("host_"))
    src = src.join(classes, src["host_"].eqNullSafe(classes["host"])).select(key, "text_", "classes_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for k, t, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got = slots_of(t or "", c)
                keys += [k] * len(got)
                rows += got
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.string()))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *cols], names=[key, "marks", "depth", "body"])

    return src.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, marks string, depth int, body string")
