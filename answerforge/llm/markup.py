"""Problem 1: markup residue (HTML, Markdown, wiki, LaTeX, mixed) to clean text with its structure.

A document is cut into flat text blocks: code blocks, formulas, headings, list items, table cells and
paragraphs as their marks suggest. The marks don't settle what a block is: `# x` is a Markdown heading or a
wiki list item, `*x` an item or emphasis, `$60 or $149` money, a short line before a long paragraph a heading
without any mark, and lines, cells and items full of links are navigation. So each block is described by its
word count and link density, those of both neighbours, its mark, and its closing sign, and a decision tree,
grown on the small labelled table LABELLED, says what it is.

Items of a menu are list items of the document all the same, and are reported as such; the clean text leaves
menus and other boilerplate (navigation, footers) out.

Comments, scripts, styles and LaTeX comment lines give nothing, and nothing inside code counts.

Defined results: NULL and blank documents give no elements and NULL or empty text; an unclosed comment
or code block runs to the end of the document; an element without any word is none, unless it is a
formula or code.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerforge.llm.tree import classify, grow

CLASSES = ("text", "heading", "list_item", "code", "formula", "drop", "boilerplate", "menu_item")
TEXT, HEADING, LIST_ITEM, CODE, FORMULA, DROP, BOILERPLATE, MENU_ITEM = range(8)

_PROTECTED = re.compile(
    r"""(?P<gone><!--.*?(?:-->|\Z)|<script\b[^>]*>.*?(?:</script\s*>|\Z)|<style\b[^>]*>.*?(?:</style\s*>|\Z)|^%[^\n]*)
    |(?P<block><(?P<tag>pre|syntaxhighlight|source|listing)\b[^>]*>.*?(?:</(?P=tag)\s*>|\Z)
        |^[ ]{0,3}(?P<fence>`{3,}|~{3,})[^\n]*\n.*?(?:^[ ]{0,3}(?P=fence)[`~]*[ \t]*$|\Z)
        |\\begin\{(?P<verb>verbatim|lstlisting|minted|Verbatim|alltt)\*?\}.*?(?:\\end\{(?P=verb)\*?\}|\Z))
    |(?P<inline><code\b[^>]*>(?:(?!<code\b).)*?</code\s*>|(?P<tick>`+)(?!`)[^\n]*?(?<!`)(?P=tick)(?!`))
    |(?P<display>\$\$.+?\$\$|\\\[(?:(?!\\\[).)*?\\\]|\\begin\{(?P<env>equation|align|gather|multline|displaymath|math|eqnarray)\*?\}(?:(?!\\begin\{(?P=env)).)*?\\end\{(?P=env)\*?\})
    |(?P<formula><math\b[^>]*>(?:(?!<math\b).)*?</math\s*>|\\\((?:(?!\\\().)*?\\\))
    |(?P<escape>\\[\\$%&\#_{}`*])
    |(?P<dollar>\$(?=\S)[^$\n]*\$)""",
    re.S | re.M | re.X | re.I,
)
_BLOCK_TAG = re.compile(r"<(/?)(h[1-6]|p|div|ul|ol|li|dl|dt|dd|table|tbody|thead|caption|tr|td|th|blockquote|section|article|header|footer|nav|hr)\b[^>]*>", re.I)
_LINE = re.compile(
    r"""(?P<wiki>(?P<eq>={1,6})(?!=)\s*(?P<wiki_text>[^=\s].*?)\s*(?P=eq))\s*$
    |(?P<tex>\\(?:part|chapter|(?:sub)*section|paragraph)\*?\{(?P<tex_text>.*?)\})
    |(?P<item>\\item\b(?:\[[^\]]*\])?)
    |(?P<hash>\#{1,6})(?!\#)
    |(?P<bullet>\*+|[-+](?=\s))
    |(?P<number>\d{1,3}[.)](?=\s))
    |(?P<row>\{\||\|[-}]?|!|\ue002)
    |(?P<indent>:+)""",
    re.X,
)
_RULE = re.compile(r"(={3,}|-{3,})\s*$")
_HOLD = re.compile("\ue000(\\d+)\ue001")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
# What opens again before it closes is no such mark; so a text full of unclosed marks is read in one pass.
_LINK = re.compile(
    r"<a\b[^>]*>((?:(?!<a\b).)*?)</a\s*>|\[\[([^\]\[]*)\]\]|!?\[([^\]\[]*)\]\([^)\s]*\)|\[(?:https?:|ftp:)?//[^\s\]\[]*([^\]\[]*)\]",
    re.S | re.I,
)
_DROP_INSIDE = re.compile(r"<ref\b[^>]*/>|<ref\b[^>]*>(?:(?!<ref\b).)*?</ref\s*>|<sup>\[\d+\]</sup>", re.S | re.I)
# Macros whose argument is no text of the page, and link targets that are none.
_SILENT = ("cite", "citep", "citet", "label", "ref", "eqref", "footnote", "pageref", "index", "vspace", "hspace", "includegraphics", "begin", "end")
_NO_PAGE = re.compile(r"\s*(?:category|file|image)\s*:", re.I)
_BRACE = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\[\n]*\])?\{|\{\{|[{}]")
_TABULAR = re.compile(r"\\begin\{(tabular|longtable|tabularx|array)\*?\}(?:\[[^\]\n]*\])?((?:\{[^{}\n]*\})*)((?:(?!\\begin\{(?:tabular|longtable|array)).)*?)\\end\{\1\*?\}", re.S)
_RULES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule)\b|\\cline\{[^}]*\}")
_CELL_STYLE = re.compile(r"^\s*(?:[\w-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s|\"']+)\s*)+\|(?!\|)")
_EMPHASIS = re.compile(r"'{2,5}|\*\*|__|(?<!\w)[_*](?=\w)|(?<=\w)[_*](?!\w)")
#: Signs that stand for a held block (two), a row of a table, a line break and an escaped ampersand of LaTeX.
_SIGNS = {0xE000 + i: " " for i in range(5)}
_WORD = re.compile(r"[^\W_]+")

MARKS = ("plain", "tag_heading", "tag_item", "cell", "wiki_heading", "tex_heading", "setext", "tex_item", "hash", "bullet", "number", "row", "indent", "code_block", "inline_code", "math", "math_dollar", "rule")


class Block:
    __slots__ = ("mark", "text", "level", "gap", "parent", "raw")

    def __init__(self, mark: str, text: str, level: int = 0, gap: bool = True, raw: str = ""):
        self.mark, self.text, self.level, self.gap, self.raw = mark, text, level, gap, raw
        self.parent = -1


def _link_words(m: re.Match) -> str:
    if m[2] is not None:
        return "" if _NO_PAGE.match(m[2]) else m[2].rsplit("|", 1)[-1]
    return m[1] or m[3] or (m[4] or "").strip()


def unbraced(s: str) -> str:
    """Templates and silent macros gone, whatever they hold; other macros give way to their argument. One pass with a
    stack, so depth doesn't matter; what never closes keeps its text."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    at = 0
    while m := _BRACE.search(s, at):
        stack[-1][1].append(s[at : m.start()])
        at = m.end()
        if m[0] != "}":
            stack.append((m[1] or m[0], []))
            continue
        kind, inside = stack[-1]
        if kind == "" or kind == "{{" and s[at : at + 1] != "}":
            inside.append("}")
            continue
        stack.pop()
        if kind == "{{":
            at += 1
        elif kind == "{":
            stack[-1][1].append("{" + "".join(inside) + "}")
        elif kind.lower() not in _SILENT:
            stack[-1][1].extend(inside)
    stack[-1][1].append(s[at:])
    return "".join(("{" if kind == "{" else "") + "".join(inside) for kind, inside in stack)


def table_row(s: str, sign: str) -> str:
    """The cells of one line of a wiki or Markdown table, between bars; lines without content are empty."""
    if sign in ("{|", "|-", "|}") and not (sign == "|-" and "|" in s):
        return ""
    if re.fullmatch(r"[-:|\s]*", s):
        return ""
    parts = re.split(r"!!|\|\|", s) if sign == "!" or "||" in s else [s] if _CELL_STYLE.match(s) else _outside_links(s.lstrip("+"))
    cells = [_CELL_STYLE.sub("", p).strip() for p in parts]
    return " | ".join(c for c in cells if c)


def _outside_links(s: str) -> list[str]:
    """Parts between bars, but for bars inside double square brackets."""
    return [p.replace("\ue002", "|") for p in re.sub(r"\[\[[^\]\[]*\]\]", lambda m: m[0].replace("|", "\ue002"), s).split("|")]


def _tabular(m: re.Match) -> str:
    rows = (_RULES.sub("", r) for r in m[3].split("\ue003"))
    return "\n" + "\n".join("\ue002 " + " | ".join(" ".join(c.split()) for c in r.split("&")) for r in rows if r.strip()) + "\n"


def inner_text(s: str) -> str:
    """Readable text of a block: links to their words, tags, notes, templates and emphasis gone."""
    s = _DROP_INSIDE.sub("", s)
    s = unbraced(s) if "{" in s else s
    s = _LINK.sub(_link_words, s)
    s = _TAG.sub(" ", s) if "<br" in s.lower() else _TAG.sub("", s)
    s = _EMPHASIS.sub("", s).replace("~", " ").replace("\ue003", " ").replace("\ue004", "&")
    return " ".join(entities.unescape(s).split())


def _count(s: str) -> int:
    return len(_WORD.findall(s))


def segment(doc: str) -> list[Block]:
    """Flat blocks in document order. Formulas and inline code inside a block follow it, with its index as parent."""
    held: list[Block] = []
    doc = doc.translate(_SIGNS)

    def protect(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup in ("gone", "block", "inline", "display", "formula", "escape", "dollar") else next(k for k in ("gone", "block", "inline", "display", "formula", "escape", "dollar") if m[k] is not None)
        if kind == "gone":
            return ""
        if kind == "escape":
            return {"\\": "\ue003", "&": "\ue004"}.get(m[0][1], m[0][1]) if m[0][1] not in "*`#_" else "\\" + m[0][1]
        mark = {"block": "code_block", "inline": "inline_code", "dollar": "math_dollar"}.get(kind, "math")
        held.append(Block(mark, m[0], 1 if kind in ("block", "display") else 0))
        hold = f"\ue000{len(held) - 1}\ue001"
        return f"\n\n{hold}\n\n" if kind == "block" else hold

    plain, at = [], 0
    while m := _PROTECTED.search(doc, at):
        plain.append(doc[at : m.start()])
        if m["dollar"] is not None and not _is_math_span(doc, m):
            plain.append("$")  # an amount; look again right behind this sign
            at = m.start() + 1
            continue
        plain.append(protect(m))
        at = max(m.end(), at + 1)
    masked = "".join(plain) + doc[at:]
    if "\\begin{" in masked:
        masked = _TABULAR.sub(_tabular, masked)

    blocks: list[Block] = []

    def add(mark: str, text: str, level: int = 0, gap: bool = True, raw: str = "") -> None:
        own = Block(mark, text, level, gap, raw)
        spans = [held[int(i)] for i in _HOLD.findall(text)]
        if len(spans) == 1 and mark in ("plain", "indent", "cell") and not _HOLD.sub("", _TAG.sub("", text)).strip():
            blocks.append(spans[0])  # the block is nothing but this
            return
        here = len(blocks)
        blocks.append(own)
        for s in spans:
            s.parent = here
            blocks.append(s)

    def lines(piece: str) -> None:
        rows = piece.split("\n")
        skip = False
        for i, line in enumerate(rows):
            s = line.strip()
            if skip or not s:
                skip = False
                continue
            under = rows[i + 1].strip() if i + 1 < len(rows) else ""
            m = _LINE.match(s)
            if _RULE.fullmatch(s):
                add("rule", s)
            elif not m and len(under) >= 3 and _RULE.fullmatch(under):
                add("setext", s, 1 if under[0] == "=" else 2)
                skip = True
            elif not m:
                add("plain", s)
            elif m["wiki"]:
                add("wiki_heading", m["wiki_text"], len(m["eq"]))
            elif m["tex"]:
                add("tex_heading", m["tex_text"], 1 + m["tex"].count("sub"))
            else:
                mark = "tex_item" if m["item"] else next(k for k in ("hash", "bullet", "number", "row", "indent") if m[k])
                rest = s[m.end() :]
                rest_text = rest.strip().rstrip("#").rstrip() if mark == "hash" else table_row(rest, m[0]) if mark == "row" else rest.strip()
                add(mark, rest_text, len(m[0]), rest[:1].isspace(), s)

    at, opened, filled = 0, None, False
    for m in [*_BLOCK_TAG.finditer(masked), None]:
        piece = masked[at : m.start() if m else len(masked)]
        if opened and opened[0] == "h":
            closes = m is None or m[2].lower()[0] == "h" or not m[1]
            if piece.strip():
                first, _, rest = piece.partition("\n") if not (m and m[1] and m[2].lower() == opened) else (piece, "", "")
                add("tag_heading", first.strip(), int(opened[1]))
                lines(rest)
            if not closes:
                opened = None
        elif opened == "li":
            first, _, rest = piece.lstrip().partition("\n")
            if first.strip():
                add("tag_item", first.strip())
                filled = True
            lines(rest)
        elif opened in ("td", "th"):
            if piece.strip():
                add("cell", piece.strip())
        else:
            lines(piece)
        if m:
            name = m[2].lower()
            if opened == "li" and not filled and name in ("p", "div", "section", "article", "blockquote"):
                at = m.end()  # an item stays open until its text comes
                continue
            filled = False
            opened = None if m[1] else name if name in ("li", "td", "th") or name[0] == "h" and name[1:].isdigit() else None
            at = m.end()
    return blocks


def _is_math_span(doc: str, m: re.Match) -> bool:
    """A dollar span is worth a look by the tree unless it touches word characters on the wrong sides;
    whether it is a formula or two amounts the tree decides from the signs around it."""
    inner = m[0][1:-1]
    return bool(inner) and not inner[-1].isspace() and not doc[m.end() : m.end() + 1].isdigit()


def _density(b: Block) -> float:
    """Share of a block's words that stand in links."""
    linked = sum(_count(_link_words(m)) for m in _LINK.finditer(b.text))
    return linked / max(1, _count(inner_text(b.text)))


#: What the tree sees of a block. Of equally good splits the first wins, so what the block itself shows stands first.
SIZES = ("words", "links")
NEIGHBOURS = ("words_before", "words_after", "links_before", "links_after")
SIGNS = ("same_before", "same_after", "first_or_last", "level", "gap", "slanted", "math_signs", "amount")
FEATURES = (*SIZES, "ends", *MARKS, *SIGNS, *NEIGHBOURS)


def features(blocks: list[Block]) -> np.ndarray:
    """One row of FEATURES per block. A neighbour is the block before or after in the flow; formulas and code inside
    a block have none."""
    flow = [i for i, b in enumerate(blocks) if b.parent < 0]
    place = {i: k for k, i in enumerate(flow)}
    said = [inner_text(b.text) if b.mark not in ("code_block", "inline_code", "math", "math_dollar") else b.text for b in blocks]
    size = [_count(t) for t in said]
    dense = [_density(b) if b.parent < 0 and ("[" in b.text or "<" in b.text) else 0.0 for b in blocks]
    out = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        k = place.get(i, -1)
        before = flow[k - 1] if k > 0 else -1
        after = flow[k + 1] if 0 <= k < len(flow) - 1 else -1
        inner = b.text.strip("$")
        row = (
            size[i],
            dense[i],
            said[i][-1:] in ".!?:" and said[i] != "" and not re.search(r"\b[A-Z]\.[A-Z]?\.?$|\b[A-Z]\.$", said[i]),
            *(m == b.mark for m in MARKS),
            before >= 0 and blocks[before].mark == b.mark and blocks[before].level == b.level,
            after >= 0 and blocks[after].mark == b.mark and blocks[after].level == b.level,
            before < 0 or after < 0,
            b.level,
            b.gap,
            b.mark == "bullet" and bool(re.match(r"\*\S[^*]*\S?\*", b.raw)),
            b.mark == "math_dollar" and bool(re.search(r"[=^_\\{}]", inner)),
            bool(re.match(r"\d[\d.,]*(\s+\w+|$)", inner)) and b.mark == "math_dollar",
            size[before] if before >= 0 else 0,
            size[after] if after >= 0 else 0,
            dense[before] if before >= 0 else 0.0,
            dense[after] if after >= 0 else 0.0,
        )
        out[i] = row
    return out


#: Small labelled table: a document, and the class of each of its blocks in order (T text, H heading, L list
#: item, C code, F formula, D drop, B boilerplate, M item of a menu). `‹n` stands for n words of running text.
LABELLED = (
    ("<p>The long road met the hill in spring. It was cold.</p>", "T"),
    ("Some plain words stand here.\n\nMore plain words follow in a paragraph of some length.", "TT"),
    ("<h1>Old Town</h1>\n<p>Words of text.</p>\n<h4><span id='s1'>See also</span></h4>", "HTH"),
    ("<h2>Early life</h2>\n<ul><li>one thing</li><li>The band met the queen.</li></ul>", "HLL"),
    ("<UL><LI>The band met <a href='/w/q'>the queen</a>.\n<LI>A song won.\n</UL>", "LL"),
    ("== Early years ==\n\nText of the part.\n\n=== Notes ===\n\n====More====", "HTHH"),
    ("\\section{Early years}\n\nText goes on here.\n\n\\subsection*{See also}", "HTH"),
    ("Early years\n-----------\n\nText goes on here.\n\nNotes\n=====", "HTH"),
    ("# Old Town\n\nText goes on here at length.\n\n## Notes\n\nText again.\n\n### Early years", "HTHTH"),
    ("## Early life ##\n\nText goes on.\n\n#### Use in Oldtown", "HTH"),
    ("# Old Town F.C.\n\nText goes on here at length.", "HT"),
    ("# Notes\n\n# Early years", "HH"),
    ("# Old Town\n\n# Notes of the town\n\nText goes on here.", "HHT"),
    ("## Notes\n\n## Early years ##\n\n## History of Oldtown", "HHH"),
    ("<h3>Notes</h3>\n\n<h3>See also</h3>\n<h3>Old Town</h3>\n<h3>Use in Newtown</h3>", "HHHH"),
    ("<h1>Old Town</h1><h1>Notes</h1>\n<H2 CLASS='sec'>Notes</H2>\n<H2>Early years</H2>", "HHHH"),
    ("\\section{Notes}\n\n\\section{See also}\n\n\\section*{Old Town}\n\n\\subsection{Use}\n\n\\subsection{Notes}", "HHHHH"),
    ("== Notes ==\n\n== See also ==\n\n===Old Town===\n\n=== Notes ===", "HHHH"),
    ("Notes\n-----\n\nSee also\n--------\n\nEarly years\n===========\n\nOld Town\n========", "HHHH"),
    ("<h1>Old Town F.C.</h1>\n<h1>Is it so?</h1>\n== What is it? ==\n\n== Old Town F.C. ==\n\n\\section{Old Town F.C.}", "HHHHH"),
    ("Text before.\n\n# The band met the queen.\n# A song won the game.\n# The road saw the hill.", "TLLL"),
    ("Text before it.\n\n#The band met the queen.\n#A song won the game.", "TLL"),
    ("Text before it.\n\n# The band met the queen.\n\nText after it.", "TLT"),
    ("# The road of the [[hill]] met the old queen in town.\n# Sold.", "LL"),
    ("* The band met the queen.\n* A song won.\n* See also", "LLL"),
    ("*The band met the queen.\n*A song won the game.", "LL"),
    ("**Old** town met the queen.\n\n**Bold words** open this line.", "TT"),
    ("*Quiet* words open this line.\n\n*Some slanted words* open a line.", "TT"),
    ("** The nested band met the queen.\n** A song won.", "LL"),
    ("- The band met the queen.\n- A song won.\n- Hill", "LLL"),
    ("+ The band met the queen.\n+ A song won.", "LL"),
    ("1. The band met the queen.\n2. A song won.\n3. Hill", "LLL"),
    ("\\begin{itemize}\n\\item Hill\n\\item first \\emph{one}\n\\item Old [[town]] road\n\\end{itemize}", "TLLLT"),
    ("1. Hill\n2. Old road\n3. first {{x}} one", "LLL"),
    ("+ Hill\n+ Old road", "LL"),
    ("*Hill\n*Old road", "LL"),
    ("<li>Hill</li><li>Old {road}</li>", "LL"),
    ("\\begin{itemize}\n\\item The band met the queen.\n\\item A song won.\n\\end{itemize}", "TLLT"),
    ("Words.\n\n----\n\nWords again.", "TDT"),
    ("<table><tr><th>Name</th><th>Score</th></tr><tr><td>Old Town</td><td>12</td></tr></table>", "TTTT"),
    ("{| class='wikitable'\n! Name !! Score\n|-\n| Old Town || 12\n|}", "TTTTT"),
    ("| Name | Score |\n|---|---|\n| Old Town | 12 |", "TTT"),
    ("<pre># load it\n- step\n== x ==</pre>", "C"),
    ("```python\nprint($x)\n```\n\nWords.\n\n~~~\n* kept\n~~~", "CTC"),
    ("\\begin{verbatim}\n# x\n\\end{verbatim}\n\n<syntaxhighlight lang='x'>\na = 1\n</syntaxhighlight>", "CC"),
    ("The `band` met the queen.", "TD"),
    ("The <code>x = y</code> met the queen.", "TD"),
    ("<p>The <math>x = y^{2}</math> met \\(k = 3\\) there.</p>", "TFF"),
    ("The $x_{0} + v = 3$ hill met $y = 2$ there, and $\\alpha$ too, or $n$.", "TFFFF"),
    ("$$\nx = y\n$$\n\n\\[k = m\\]\n\n\\begin{equation}\nx = 1\n\\end{equation}", "FFF"),
    (":<math>x = y</math>\n\n<div class='tex'>\\[x = y\\]</div>", "FF"),
    ("It sold for $60 or $149 there, at (\\$71).", "T"),
    ("It sold for $60 and x$ there.", "TD"),
    ("* The $x = 3$ band met.\n* It cost $5 or $6.", "LFL"),
    (": an indented line of talk", "T"),
    # Pages where size, links and neighbours tell: headings without marks, navigation, menus, footers.
    ("Early years\n\n‹40.\n\n‹25.\n\nThe long winter\n\n‹60.", "HTTHT"),
    ("‹30.\n\nTrade by the river\n\n‹45.\n\nNotes\n\n‹20.", "THTHT"),
    ("<p>‹30.</p>\n<p>Roads and boats</p>\n<p>‹50.</p><p>Later years</p><p>‹24.</p>", "THTHT"),
    ("‹40\n\nOld Town\n\n‹22\n\nUse of the road\n\n‹70", "THTHT"),
    ("Old Town\n\nHill Street\n\nBox 12\n\nNewtown", "TTTT"),
    ("Roses on the hill\nboats on the sea\na road to the town\nand no more to see", "TTTT"),
    ("‹35.\n\nThe band met.\n\n‹28.\n\nIt was cold!\n\n‹33.", "TTTTT"),
    ("‹35.\n\n‹14\n\n‹28.\n\n‹11\n\n‹50.", "TTTTT"),
    ("<div><a href='/'>Home</a> <a href='/n'>News</a> <a href='/s'>Sport</a> <a href='/w'>Weather today</a></div>\n<h1>Old Town</h1>\n<p>‹40.</p>", "BHT"),
    ("<div><a href='/'>Home</a></div><div><a href='/n'>Old news</a></div><div><a href='/s'>All sport pages</a></div><p>‹45.</p>", "BBBT"),
    ("<p>‹38.</p><p>‹52.</p><div><a href='/c'>Contact us</a> | <a href='/p'>Privacy</a></div><div>Copyright 2013 Old Town Trust</div>", "TTBB"),
    ("<p>‹38.</p><div><a href='/p'>Privacy</a> <a href='/t'>Terms of use</a></div><div>All rights reserved.</div><div><a href='/t'>Top</a></div>", "TBBB"),
    ("‹33.\n\n[Print](/p) [Send to a friend](/s) [Share](/x)\n\n‹47.", "TBT"),
    ("‹33.\n\n[Next page](/p)\n\n[Back to the list](/s)", "TBB"),
    ("<p>‹20 <a href='/q'>the queen</a> ‹25.</p><p><a href='/o'>Old Town</a> met ‹12 near <a href='/r'>the river</a>.</p>", "TT"),
    ("<p><a href='/o'>Old Town</a> paid the <a href='/q'>queen</a>.</p><p>‹30 <a href='/r'>the river</a>.</p>", "TT"),
    ("<p>The [town](/t) met <a href='/q'>the queen</a> of it.</p><p>‹30.</p><p><a href='/o'>Old Town</a> sold ‹4.</p>", "TTT"),
    ("<ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/s'>All sport</a></li><li><a href='/w'>Weather of the day</a></li></ul><h1>Old Town</h1><p>‹42.</p>", "MMMMHT"),
    ("* [Home](/)\n* [News of today](/n)\n* [Sport](/s)\n\n‹50.", "MMMT"),
    ("- [[Home]]\n- [[Old Town|The town]]\n- [[Sport pages]]\n- [[Help]]", "MMMM"),
    ("<p>‹40.</p><ul><li><a href='/a'>About us</a></li><li><a href='/j'>Jobs</a></li><li><a href='/p'>Privacy</a></li></ul>", "TMMM"),
    ("<ul><li>The band met <a href='/q'>the queen</a>.</li><li><a href='/o'>Old Town</a> sold a song.</li><li>‹9.</li></ul>", "LLL"),
    ("* The [[road]] met ‹5.\n* [[Old Town]] paid the queen in [[1936]].\n* ‹12.", "LLL"),
    ("1. [Old Town](/o) ‹6.\n2. ‹11.\n3. The [queen](/q) of it.", "LLL"),
    # Hash signs: short lines over text are headings, lines of a sentence's length are items.
    ("‹25.\n\n# Old road\n\n‹35.\n\n# Trade\n\n‹48.", "THTHT"),
    ("# ‹5.\n# ‹8.\n# ‹6 {{x}}.\n\n‹40.", "LLLT"),
    ("‹40.\n\n#‹4.\n#‹9.\n#‹7.\n\n## Later years\n\n‹30.", "TLLLHT"),
    ("# ‹7\n# ‹6\n# ‹9", "LLL"),
    ("‹50 [[road]].\n\n# ‹3.\n# ‹4.\n# Sold.\n\n‹22.\n\n# ‹4.\n\n‹60.", "TLLLTLT"),
    ("‹50 [[road]].\n\n# ‹3\n\n‹60.\n\n## Notes\n\n‹44 [[hill]].\n\n# ‹4\n\n### See also\n\n#### ‹2", "THTHTHHH"),
    ("* ‹6.\n\n# ‹3\n\n# ‹2\n\n* ‹3 [[road]].\n\n# ‹1\n\n```\nx\n```\n\n# ‹4", "LHHLHCH"),
    ("## Use in Oldtown\n\n- ‹5.\n- ‹8.\n\n### Notes\n\n| Name | Score |\n|---|---|", "HLLHTT"),
    ("# Old Town\n\n```\nx = 1\n```\n\n## Old Town River\n\n$$x = 1$$", "HCHF"),
    # Marks that leave no doubt, at all sizes, levels and signs at the end.
    ("<h5>Old Town</h5><p>‹20.</p><h6>Notes of the long road</h6><p>‹30.</p><h5>Is it so?</h5><h6>It was cold.</h6>", "HTHTHH"),
    ("<h2>‹7</h2><p>‹20.</p><h3>‹11</h3><p>‹30.</p><h2>‹9.</h2><h1>‹6?</h1>", "HTHTHH"),
    ("== ‹7 ==\n\n‹20.\n\n===== ‹5 =====\n\n‹9.\n\n====== Notes ======\n\n=== ‹8. ===\n\n== It is so? ==", "HTHTHHH"),
    ("\\section{‹7}\n\n‹20.\n\n\\subsubsection{‹6.}\n\n‹9.\n\n\\section{What is it?}\n\n\\paragraph{‹9}\n\n\\chapter{It was cold.}", "HTHTHHH"),
    ("‹7\n=======\n\n‹20.\n\n‹5.\n-----\n\n‹8?\n---\n\n‹30.\n\nWhat is it?\n======", "HTHHTH"),
    ("##### ‹3\n\n‹20.\n\n###### Notes\n\n‹30.\n\n##### Old Town", "HTHTH"),
    ("<ul><li>‹3</li><li>‹9</li><li>‹14</li><li>‹22.</li><li>‹2</li></ul>", "LLLLL"),
    ("\\begin{enumerate}\n\\item ‹2\n\\item ‹3\n\\item ‹9\n\\item ‹14\n\\item ‹22.\n\\item ‹5?\n\\end{enumerate}", "TLLLLLLT"),
    ("* ‹2\n* ‹3\n* ‹9\n* ‹14\n* ‹22.\n** ‹5\n*** ‹5.", "LLLLLLL"),
    ("- ‹2\n- ‹3\n- ‹9\n+ ‹14\n+ ‹22.\n+ ‹5", "LLLLLL"),
    ("1. ‹2\n2. ‹3\n3) ‹9\n4) ‹14\n5. ‹22.\n16. ‹5\n117. ‹5", "LLLLLLL"),
    ("<table><tr><td>‹2</td><td>‹9.</td><td>‹22.</td></tr></table>\n: ‹3\n:: ‹12\n: ‹20.\n| ‹3 | ‹2 |\n| ‹9 | ‹12. |", "TTTTTTTT"),
    ("‹2 <code>a</code> ‹3 `b.` ‹4 `‹3` ‹5 <code>‹6.</code> ‹7", "TDDDD"),
    ("<pre>a</pre>\n<pre>‹6.</pre>\n```\n‹12\n```\n<pre>\n‹30.\n</pre>", "CCCC"),
    ("$$‹6$$\n\n\\[x.\\]\n\n<math>‹12</math>\n\n‹5 <math>y</math> ‹6 \\(‹3.\\) ‹2 $a + b = c_{1}.$ ‹4", "FFFTFFF"),
    ("---\n\n‹12.\n\n=====\n\n-----", "DTDD"),
    ("<table><tr><td><a href='/o'>Old Town</a></td><td>12</td></tr><tr><td><a href='/r'>River</a></td><td>7</td></tr></table><p>‹30.</p>", "TTTTT"),
)
_LETTER = {"T": TEXT, "H": HEADING, "L": LIST_ITEM, "C": CODE, "F": FORMULA, "D": DROP, "B": BOILERPLATE, "M": MENU_ITEM}
_FILLER = "the old town stood by a river and its people kept the long road open in winter while boats went down to the sea".split()


def filled(doc: str) -> str:
    """A labelled document with its running text."""
    return re.sub(r"‹(\d+)", lambda m: " ".join(_FILLER[(i * 7 + int(m[1])) % len(_FILLER)] for i in range(int(m[1]))).capitalize(), doc)


def labelled_rows(table) -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for doc, letters in table:
        blocks = segment(filled(doc))
        if len(blocks) != len(letters):
            raise ValueError(f"{len(blocks)} blocks, {len(letters)} labels: {doc!r} {[(b.mark, b.text) for b in blocks]}")
        x.append(features(blocks))
        y += [_LETTER[c] for c in letters]
    return np.concatenate(x), np.array(y)


@lru_cache(maxsize=1)
def block_tree():
    return grow(*labelled_rows(LABELLED), len(CLASSES))


def label_blocks(doc: str) -> list[tuple[Block, int]]:
    blocks = segment(doc)
    tree = block_tree()
    return [(b, classify(tree, row)) for b, row in zip(blocks, features(blocks))]


def elements(doc: str | None) -> list[tuple[str, int]]:
    """(class, number from 1 per class) of headings, list items, code blocks and formulas in document order."""
    out, seen = [], [0] * len(CLASSES)
    for b, c in label_blocks(doc) if doc else ():
        c = LIST_ITEM if c == MENU_ITEM else c
        if c in (HEADING, LIST_ITEM, CODE, FORMULA) and (c in (CODE, FORMULA) or _count(inner_text(b.text))):
            seen[c] += 1
            out.append((CLASSES[c], seen[c]))
    return out


def _code_body(raw: str) -> str:
    body = re.sub(r"^\s*(?:<[^>]*>\s*?(?:<code[^>]*>)?|[`~]{3,}[^\n]*\n|\\begin\{\w+\*?\}(?:\[[^\]]*\])?\n?)|(?:</code>)?\s*</[^>]*>\s*$|[`~]{3,}\s*$|\\end\{\w+\*?\}\s*$", "", raw, flags=re.I)
    return entities.unescape(body).strip("\n")


def _formula_body(raw: str) -> str:
    return re.sub(r"^(?:<math[^>]*>|\$+|\\[\[(]|\\begin\{\w+\*?\})|(?:</math\s*>|\$+|\\[\])]|\\end\{\w+\*?\})$", "", raw.strip(), flags=re.I).strip()


def clean_text(doc: str | None) -> str | None:
    """The document as plain text: headings as '#' lines, items as '- ', code fenced, formulas between dollars."""
    if doc is None:
        return None
    labelled = label_blocks(doc)
    spans: dict[int, list[tuple[Block, int]]] = {}
    for b, c in labelled:
        if b.parent >= 0:
            spans.setdefault(b.parent, []).append((b, c))
    out = []
    for i, (b, c) in enumerate(labelled):
        if b.parent >= 0:
            continue
        if c == CODE:
            out.append("```\n" + _code_body(b.text) + "\n```")
        elif c == FORMULA:
            out.append(f"$${_formula_body(b.text)}$$")
        elif c not in (DROP, BOILERPLATE, MENU_ITEM):
            own = iter(spans.get(i, ()))

            def put(_m, own=own):
                s, kind = next(own)
                return f"${_formula_body(s.text)}$" if kind == FORMULA else _formula_body(s.text).strip("`") if s.mark != "math_dollar" else s.text

            said = _HOLD.sub(put, inner_text(b.text))
            if said:
                out.append("#" * max(1, min(6, b.level)) + " " + said if c == HEADING else "- " + said if c == LIST_ITEM else said)
    return "\n".join(out)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, kinds, numbers = [], [], []
        for rid, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for kind, no in elements(doc):
                ids.append(rid)
                kinds.append(kind)
                numbers.append(no)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(numbers, pa.int32())], names=["record_id", "element", "item_no"])


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([clean_text(d) for d in docs], pa.string())], names=["record_id", "clean_text"])


def structure_elements(df: DataFrame, key: str, doc: str) -> DataFrame:
    """(record_id, element, item_no); narrow, one Arrow pass."""
    return df.select(F.col(key).cast("bigint").alias("record_id"), F.col(doc).alias("doc")).where("doc is not null").mapInArrow(_found, "record_id bigint, element string, item_no int")


def cleaned_documents(df: DataFrame, key: str, doc: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("record_id"), F.col(doc).alias("doc")).mapInArrow(_cleaned, "record_id bigint, clean_text string")


def wrong_tokens(df: DataFrame, key: str, tokens: str, flag: str = "is_html", token: str = "token") -> DataFrame:
    """(record_id, element, item_no) of tokens whose markup flag is NULL or differs from what the token is:
    markup is one whole opening or closing tag. A NULL entry of the array has no flag to judge and is none."""
    each = df.select(F.col(key).cast("bigint").alias("record_id"), F.posexplode(tokens).alias("item_no", "t"))
    is_tag = F.col(f"t.{token}").rlike(r"(?s)\A</?[A-Za-z][^>]*>\z")
    wrong = F.col("t").isNotNull() & (F.col(f"t.{flag}").isNull() | (F.col(f"t.{flag}") != is_tag))
    return each.where(wrong).select("record_id", F.lit("token").alias("element"), "item_no")
