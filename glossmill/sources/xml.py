"""Flatteners of XML documents: annotated text, PAGE, ALTO, ABBYY, hOCR, parliamentary proceedings.

Each gives node rows (see operators.tree) or the format's own flat table; all
further work on them is DataFrame operations.
"""

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossmill.operators.headers import HEADER
from glossmill.operators.tree import NODES
from glossmill.sources import files

#: Regions that become paragraphs and heads; style flags of character formatting; features of speakers.
PARAGRAPH_TYPES, HEAD_TYPES = ("", "paragraph"), ("heading", "header")
STYLE_FLAGS = ("bold", "italic", "subscript", "superscript", "smallcaps", "underline", "strikeout")
SPEAKER_FEATURES = ("speaker", "function", "party", "role", "party-ref", "member-ref")
#: Tags of annotated text that carry structure or text; others are annotations or markup.
STRUCTURE = ("text", "div", "p", "s", "w", "str", "head", "note", "list", "item", "figure", "caption", "table", "row", "cell", "event", "quote", "speech", "entry", "term", "def", "ex", "ref", "br", "whitespace", "utt")
NODE_COLUMNS = [field.split()[0] for field in files.split_schema(NODES)]
ANNOTATIONS = ("lemma", "pos", "lang", "sense", "metric", "entity", "morpheme", "feat", "subjectivity", "domain")
NODE_TAGS = frozenset(STRUCTURE + ANNOTATIONS)


class Nodes:
    """Collects node rows in document order."""

    def __init__(self, doc_id: str):
        self.doc_id, self.rows, self.paths = doc_id, [], {}

    def add(self, tag: str, parent: dict | None = None, node_id: str | None = None, cls: str | None = None, lang: str | None = None, space: bool = True, texts: dict | None = None, attrs: dict | None = None, set_: str | None = None, spans: list | None = None) -> dict:
        made = node_id or f"{parent['node_id'] if parent else self.doc_id}.{tag}.{len(self.rows) + 1}"
        above = self.paths.get(id(parent))
        if above is None:  # one pair of lists for all children of a node
            above = self.paths[id(parent)] = ([*parent["path"], parent["tag"]], [*parent["path_ids"], parent["node_id"]]) if parent else ([], [])
        row = {
            "doc_id": self.doc_id,
            "node_id": made,
            "parent_id": parent["node_id"] if parent else None,
            "path": above[0],
            "path_ids": above[1],
            "ord": len(self.rows),
            "depth": len(above[0]),
            "tag": tag,
            "cls": cls,
            "set": set_,
            "lang": lang or (parent["lang"] if parent else None),
            "space": space,
            "texts": texts or {},
            "attrs": attrs or {},
            "spans": spans or [],
            "label": (f"{parent['label']}/" if parent else "") + f"{len(self.rows):08x}",
        }
        self.rows.append(row)
        return row


@lru_cache(4096)
def bare(name: str) -> str:
    """A name without its namespace."""
    return name.rpartition("}")[2]


def local(element) -> str:
    """An element's name without its namespace; comments and the like have none."""
    return bare(element.tag) if isinstance(element.tag, str) else ""


def attributes(element) -> dict[str, str]:
    """Attributes by name without namespace."""
    return {bare(k): v for k, v in element.attrib.items()}


def root_of(data: bytes):
    """The root element of an XML document."""
    import xml.etree.ElementTree as ET

    return ET.fromstring(data)


def stem(path: str) -> str:
    """The file's name without folder and extensions."""
    return re.sub(r"(\.[a-z]+)*(\.(gz|bz2))?$", "", path.rpartition("/")[2]).replace(":", "_")


def text_of(element) -> str:
    """All text of a text element, its markup left out; line breaks and set spaces are spaces, hyphens at line ends are dropped."""
    if not len(element):
        return element.text or ""
    said = {"br": " ", "t-hspace": " ", "t-hbr": ""}
    return "".join(said.get(x["kind"], x["text"]) for x in text_parts(element))


def text_parts(element, tag: str | None = None) -> list[dict]:
    """The parts (kind, text, tag) of a text element in order: plain text, br, t-hbr and t-hspace; tag is that of the markup around, if any."""
    out = [{"kind": "text", "text": element.text, "tag": tag}] if element.text else []
    for child in element:
        name, own = local(child), attributes(child)
        if name in ("br", "t-hbr", "t-hspace"):
            out.append({"kind": name, "text": "".join(child.itertext()) or own.get("text", ""), "tag": tag})
        elif name and name not in ("feat", "desc", "comment"):
            out += text_parts(child, own.get("tag") or tag)
        if child.tail:
            out.append({"kind": "text", "text": child.tail, "tag": tag})
    return out


#: A correction and its parts.
CORRECTION = ("correction", "new", "current", "original", "suggestion")
#: What is read of a correction, by how corrections are handled; "either" reads the first that has anything.
HANDLING = {"current": (("new", "current"),), "original": (("original",),), "either": (("new", "current"), ("original",))}


XML_ID = "{http://www.w3.org/XML/1998/namespace}id"


class Bare(dict):
    """Names without their namespaces, each worked out once; comments and the like have none."""

    def __missing__(self, tag):
        self[tag] = found = tag.rpartition("}")[2] if isinstance(tag, str) else ""
        return found


def annotated(path: str, data: bytes, corrections: str = "current"):
    """Node rows of an annotated document; corrections: current, original or either, as totext has it, or kept, as nodes with all their parts."""
    return [dict(zip(NODE_COLUMNS, row, strict=False)) for row in annotated_rows(path, data, corrections)]


def annotated_rows(path: str, data: bytes, corrections: str = "current") -> list[tuple]:
    """What annotated gives, as tuples in the order of NODES and, last, whether nothing is below; nodes share lists and empty maps where they are the same."""
    root = root_of(data)
    names, rows, none = Bare(), [], []
    doc_id = attributes(root).get("id") or stem(path)
    nothing, kept, handled = {}, corrections == "kept", HANDLING.get(corrections, ())

    def chosen(correction):
        """The lists of elements that a correction is read as, best first."""
        return [[x for part in correction if names[part.tag] in known for x in part] for known in handled]

    def texts(own: list, corrected: list) -> dict:
        """Text elements by layer: an element's own, else those of corrections in it."""
        found = {}
        for child in own:
            found.setdefault(attributes(child).get("class", "current") if child.attrib else "current", child)
        for child in corrected:
            for elements in chosen(child):
                inner = texts([x for x in elements if names[x.tag] == "t"], [x for x in elements if names[x.tag] == "correction"])
                found = inner | found
        return found

    def layers(own: list, corrected: list, inside: bool) -> tuple[dict, list]:
        said, spans = {}, none
        for layer, t in texts(own, corrected).items():
            text = text_of(t)
            said[layer] = text.strip() if inside else " ".join(text.split())
            if len(t):
                parts = [x | {"layer": layer, "text": x["text"] if x["kind"] != "text" else re.sub(r"\s+", " ", x["text"])} for x in text_parts(t)]
                spans = spans + parts
        return said, spans

    def visit(element, above: tuple) -> None:
        """above: id, path, ids, language and label of the node above, as its children have them; see Nodes."""
        name, attrib = names[element.tag], element.attrib
        parent, path, ids, lang, label = above
        plain = name in NODE_TAGS
        own = {names[k]: v for k, v in attrib.items()} if attrib else nothing
        if not plain:
            if not (name == "alt" or kept and name in CORRECTION):
                if name == "correction":
                    for x in next((found for found in chosen(element) if found), ()):
                        visit(x, above)
                elif name in ("entities", "morphology"):
                    for child in element:
                        visit(child, above)
                return
        said, corrected, rest, had = [], [], [], False
        for child in element:
            kind = names[child.tag]
            if kind == "t":
                said.append(child)
            else:
                rest.append(child)
                if kind == "correction":
                    corrected.append(child)
                elif kind == "lang" and plain and not had:
                    lang, had = attributes(child).get("class") or lang, True
        at = len(rows)
        node_id = own.get("id") or f"{parent or doc_id}.{name}.{at + 1}"
        label = f"{label}/{at:08x}" if label else f"{at:08x}"
        if name == "alt":
            rows.append((doc_id, node_id, parent, path, ids, at, len(path), name, None, None, lang, True, nothing, nothing, none, label, not rest))
            rest = [x for x in rest if names[x.tag] in ANNOTATIONS]
        else:
            inside = name == "w"
            if len(said) == 1 and not corrected and not said[0].attrib and not len(said[0]):
                text = said[0].text or ""
                layer, spans = {"current": text.strip() if inside else " ".join(text.split())}, none
            elif said or corrected:
                layer, spans = layers(said, corrected, inside)
            else:
                layer, spans = nothing, none
            if len(own) == ("id" in own):
                more = nothing
            elif plain:
                more = {k: v for k, v in own.items() if k not in ("id", "class", "space", "set")}
            else:
                more = {k: v for k, v in own.items() if k not in ("id", "class", "set")}
            rows.append((doc_id, node_id, parent, path, ids, at, len(path), name, own.get("class"), own.get("set"), lang, not plain or own.get("space") != "no", layer, more, spans, label, not rest))
        if rest:
            path, ids = [*path, name], [*ids, node_id]
            below, depth, top = (node_id, path, ids, lang, label), len(path), label + "/"
            for child in rest:
                attrib = child.attrib
                if len(child) == 1 and (not attrib or len(attrib) == 1 and attrib.get(XML_ID)) and (name := names[child.tag]) in NODE_TAGS:
                    t = child[0]  # most words have but an id and a text
                    if names[t.tag] == "t" and not t.attrib and not len(t):
                        at, text = len(rows), t.text or ""
                        own_id = attrib[XML_ID] if attrib else f"{node_id}.{name}.{at + 1}"
                        rows.append((doc_id, own_id, node_id, path, ids, at, depth, name, None, None, lang, True, {"current": text.strip() if name == "w" else " ".join(text.split())}, nothing, none, f"{top}{at:08x}", True))
                        continue
                visit(child, below)

    top = (None, none, none, None, "")
    for child in root:
        if names[child.tag] == "text":
            visit(child, top)
    visit = texts = None  # they refer to themselves, so the tree would wait for a collector
    return rows


def header(path: str, data: bytes):
    """Header rows of an annotated document (see operators.headers): its root, and all below `metadata`; no more of it is parsed."""
    import io
    import xml.etree.ElementTree as ET

    root, found, depth = None, None, 0
    for event, element in ET.iterparse(io.BytesIO(data), ("start", "end")):
        root, depth = (element if root is None else root), depth + (1 if event == "start" else -1)
        if event == "start" and depth == 2 and local(element) == "text":
            break
        if event == "end" and depth == 1 and local(element) == "metadata":
            found = element
            break
    space = root.tag[1:].partition("}")[0] if root.tag.startswith("{") else ""
    xml_space = "{http://www.w3.org/XML/1998/namespace}"
    doc_id, rows = attributes(root).get("id") or stem(path), []

    def add(element, label, text, tail, more=()) -> None:
        tag = element.tag.removeprefix(f"{{{space}}}") if space else element.tag
        attrs = {k.replace(xml_space, "xml:"): v for k, v in element.attrib.items()} | dict(more)
        blank = lambda x: x if x and x.strip() else None
        rows.append({"doc_id": doc_id, "label": label, "tag": tag, "attrs": attrs, "text": blank(text), "tail": blank(tail)})

    def visit(element, label) -> None:
        add(element, label, element.text, element.tail)
        for k, child in enumerate(element):
            visit(child, f"{label}/{k:08x}")

    add(root, "!", None, None, [("xmlns", space)] if space else ())
    if found is not None:
        visit(found, "!/00000000")
    return rows


REGIONS = "doc_id string, image string, region_id string, type string, pos int, read_index int, unicode string, lines array<struct<id: string, unicode: array<string>, words: array<struct<id: string, unicode: string>>>>"


def page(path: str, data: bytes, strict: bool = False):
    """Region rows of a PAGE document: its own text, its lines, and its place in the reading order; strict: a word without exactly one text is an error."""
    root = root_of(data)
    order, image, rows = {}, None, []
    for element in root.iter():
        name, own = local(element), attributes(element)
        if name == "RegionRefIndexed":
            order[own.get("regionRef")] = int(own.get("index", 0))
        elif name == "Page":
            image = own.get("imageFilename")
    if not image:
        found = re.search(rb'key="Original\.Path">([^<]*)<', data)
        image = found[1].decode("utf-8", "replace") if found else None

    def unicode(element) -> list[str]:
        return [" ".join((u.text or "").split()) for equiv in element if local(equiv) == "TextEquiv" for u in equiv if local(u) == "Unicode"]

    for pos, region in enumerate(x for x in root.iter() if local(x) == "TextRegion"):
        own, lines = attributes(region), []
        for line in (x for x in region if local(x) == "TextLine"):
            read = [(attributes(w).get("id"), unicode(w)) for w in line if local(w) == "Word"]
            if strict and (odd := [i for i, texts in read if len(texts) != 1]):
                raise ValueError(f"not one text in word {odd[0]}")
            words = [{"id": i, "unicode": next(iter(texts), None)} for i, texts in read]
            lines.append({"id": attributes(line).get("id"), "unicode": unicode(line), "words": words})
        rows.append({"doc_id": stem(path), "image": image, "region_id": own.get("id"), "type": own.get("type", ""), "pos": pos, "read_index": order.get(own.get("id")), "unicode": next((u for u in unicode(region) if u), None), "lines": lines})
    return rows


def page_units(regions: DataFrame, trust_words: bool = False, compat: bool = False) -> DataFrame:
    """(doc_id, place, region_id, tag, text, page_number) in reading order, from region rows.

    A line's text is its first that isn't empty; with trust_words it is its
    words'.  Where a line has words and they aren't trusted, compat takes the
    first word alone, as the old converter does.  A region without lines has
    its own text.  Page numbers become metadata; other types are left out.
    """
    from glossmill.operators.tree import reading_order

    known = regions.where(F.col("type").isin(*PARAGRAPH_TYPES, *HEAD_TYPES, "page-number"))
    words = lambda line: F.filter(F.transform(line["words"], lambda w: w["unicode"]), lambda u: u.isNotNull() & (u != ""))
    first = lambda line: F.get(F.filter(line["unicode"], lambda u: u != ""), F.lit(0))

    def text(line):
        own = F.coalesce(first(line), F.array_join(words(line), " "))
        if trust_words:
            return F.when(F.size(words(line)) > 0, F.array_join(words(line), " ")).otherwise(own)
        return F.when(F.size(words(line)) > 0, F.get(words(line), F.lit(0))).otherwise(own) if compat else own

    lines = F.filter(F.transform("lines", text), lambda x: x != "")
    joined = F.regexp_replace(F.array_join(lines, "\n"), r"(\p{L})[¬-]\n", "$1")
    body = F.when(F.size("lines") > 0, F.regexp_replace(joined, "\n", " ")).otherwise(F.col("unicode"))
    tag = F.when(F.col("type").isin(*HEAD_TYPES), "head").when(F.col("type") == "page-number", "br").otherwise("p")
    placed = reading_order(known).select("doc_id", "place", "region_id", tag.alias("tag"), body.alias("text"))
    return placed.withColumn("page_number", F.when(F.col("tag") == "br", F.col("text"))).where("text is not null and text <> ''")


ALTO = "file string, block_id string, block_ord int, line int, ord int, string_id string, content string, subs_type string, subs_content string"


def alto(path: str, data: bytes):
    """String rows of an ALTO page, in reading order; content of several words is split, with _1, _2, … after its id."""
    rows, ordinal, file = [], 0, path.rpartition("/")[2]
    for b, block in enumerate(x for x in root_of(data).iter() if local(x) == "TextBlock"):
        block_id = attributes(block).get("ID")  # once a block, not for each of its words
        for n, line in enumerate(x for x in block.iter() if local(x) == "TextLine"):
            for string in (x for x in line if local(x) == "String"):
                own = attributes(string)
                parts = (own.get("CONTENT") or "").split()
                for k, part in enumerate(parts):
                    name = own.get("ID") if len(parts) == 1 else f"{own.get('ID')}_{k + 1}"
                    rows.append({"file": file, "block_id": block_id, "block_ord": b, "line": n, "ord": ordinal, "string_id": name, "content": part, "subs_type": own.get("SUBS_TYPE"), "subs_content": own.get("SUBS_CONTENT")})
                    ordinal += 1
    return rows


DIDL = "doc_id string, article_id string, subject string, title string, zone_id string, part int, seq int, alto_file string, block_id string"


def didl(path: str, data: bytes):
    """(article, zone, block) rows of a DIDL index, and one without block for each ALTO file it names."""
    rows = []
    root = root_of(data)
    name = next((x.text for x in root.iter() if local(x) == "identifier" and x.text), stem(path))
    for resource in (x for x in root.iter() if local(x) == "Resource"):
        own = attributes(resource)
        if "xml" in own.get("mimeType", "") and own.get("ref"):
            rows.append({"doc_id": name, "alto_file": own["ref"].rpartition("/")[2].replace(":", "_")})
    for article in (x for x in root.iter() if local(x) == "article" or attributes(x).get("type") == "article"):
        subject = next((x.text for x in article.iter() if local(x) == "subject"), None)
        title = next((x.text for x in article.iter() if local(x) == "title"), None)
        for zone in (x for x in article.iter() if local(x) in ("zone", "area")):
            for k, part in enumerate(x for x in zone.iter() if local(x) in ("TextBlock", "block")):
                own = attributes(part)
                rows.append({"doc_id": name, "article_id": attributes(article).get("id"), "subject": subject, "title": title, "zone_id": attributes(zone).get("id"), "part": k, "seq": len(rows), "alto_file": own.get("alto"), "block_id": own.get("ID") or own.get("id")})
    return rows


def article_blocks(index: DataFrame, strings: DataFrame) -> DataFrame:
    """Strings of the blocks of each article, in order, with kind: artikel for articles, overige for the rest.

    Of blocks that an article names more than once the first counts.
    """
    from glossmill.operators.tree import first_blocks

    once = first_blocks(index.where("block_id is not null"), ["doc_id", "article_id", "block_id"], "seq")
    named = once.select("doc_id", "article_id", "subject", "zone_id", "part", "seq", F.col("alto_file").alias("file"), "block_id")
    kind = F.when(F.col("subject") == "artikel", "artikel").otherwise("overige")
    return named.join(strings, ["file", "block_id"]).withColumn("kind", kind)


def article_nodes(index: DataFrame, strings: DataFrame) -> DataFrame:
    """Node rows of articles, a document each with a paragraph for each block, and their kind in attrs of the root."""
    blocks = block_text(article_blocks(index, strings).withColumn("ord", F.struct("seq", "ord")), ["doc_id", "article_id", "kind", "seq"], order="ord")
    made = units_to_nodes(blocks.where("text <> ''"), "article_id", "seq", "p")
    kinds = blocks.select(F.col("article_id").alias("doc_id"), "kind").distinct()
    return made.join(kinds, "doc_id").withColumn("attrs", F.when(F.col("tag") == "text", F.create_map(F.lit("kind"), "kind")).otherwise(F.col("attrs"))).select(*made.columns)


def block_text(strings: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """(key..., text) of strings, words that were broken put together where both parts stand, in one block or in two that follow each other."""
    from glossmill.operators.tree import rejoin_hyphens

    whole = rejoin_hyphens(strings, [k for k in key if k not in ("block_id", "seq")] or key, order)
    return whole.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, "word"))).alias("ws")).select(*key, F.array_join("ws.word", " ").alias("text"))


RUNS = "doc_id string, page int, par int, line int, run int, text string, hyphen string, style string, ff string, fs string, lang string, flags array<string>, list_item boolean, align string, role string, box struct<t: string, l: string, r: string, b: string>, last_box struct<t: string, l: string, r: string, b: string>, lead string, trail string"


def abby(path: str, data: bytes):
    """Formatting runs of an ABBYY document with their style: the paragraph's, the named font's, then the run's own."""
    root, fonts = root_of(data), {}
    for style in (x for x in root.iter() if local(x) == "paragraphStyle"):
        own = attributes(style)
        for font in (x for x in style if local(x) == "fontStyle"):
            f = attributes(font)
            flags = ["italic"] if f.get("italic") in ("1", "true") else ["bold"] if f.get("bold") in ("1", "true") else []
            fonts[f.get("id")] = {"ff": f.get("ff"), "fs": f.get("fs"), "flags": flags, "lang": None, "role": own.get("role")}
        if own.get("mainFontStyleId") in fonts:
            fonts[own.get("id")] = fonts[own["mainFontStyleId"]]
    rows, par_no = [], 0
    nothing = {"ff": None, "fs": None, "flags": [], "lang": None, "role": None}
    for p, page_ in enumerate(x for x in root.iter() if local(x) == "page"):
        for par in (x for x in page_.iter() if local(x) == "par"):
            base = fonts.get(attributes(par).get("style"), nothing)
            listed = attributes(par).get("isListItem") in ("1", "true")
            for n, line in enumerate(x for x in par if local(x) == "line"):
                runs = [x for x in line if local(x) == "formatting"]
                for k, run in enumerate(runs):
                    own = attributes(run)
                    named = fonts.get(own.get("style"), base)
                    flags = set(named["flags"]) | {f for f in STYLE_FLAGS if own.get(f) in ("1", "true")}
                    flags -= {f for f in STYLE_FLAGS if own.get(f) in ("0", "false")}
                    variants = [next((t.text or "" for v in vs if local(v) == "wordRecVariant" for t in v.iter() if local(t) == "text"), "") for vs in run.iter() if local(vs) == "wordRecVariants"]
                    chars = [x for x in run if local(x) == "charParams"]
                    text = " ".join(v for v in variants if v) or "".join(c.text or " " for c in chars) or (run.text or "")
                    bare, hyphen = text.strip(), None
                    lead = text[: len(text) - len(text.lstrip())]
                    trail = text[len(text.rstrip()) :] if bare else ""
                    ends = k == len(runs) - 1
                    if len(bare) > 1 and (bare[-1] == "¬" or bare[-1] == "-" and ends) and bare[-2].isalpha() and not (listed and k == 0 and len(bare) < 3):
                        bare, hyphen, trail = bare[:-1], bare[-1], ""
                    if not bare and not hyphen and not lead:
                        continue
                    box, last = (attributes(chars[0]), attributes(chars[-1])) if chars else ({}, {})
                    boxes = {"box": {k_: box.get(k_) for k_ in "tlrb"}, "last_box": {k_: last.get(k_) for k_ in "tlrb"}}
                    rows.append({"doc_id": stem(path), "page": p, "par": par_no, "line": n, "run": k, "text": bare, "hyphen": hyphen, "style": own.get("style"), "ff": own.get("ff") or named["ff"], "fs": own.get("fs") or named["fs"], "lang": own.get("lang") or named["lang"], "flags": sorted(flags), "list_item": listed, "align": attributes(par).get("align"), "role": base["role"], "lead": lead, "trail": trail} | boxes)
            par_no += 1
    return rows


def abby_features(runs: DataFrame) -> DataFrame:
    """Adds features, the style of a run as (subset, class) pairs, and tag: token for what stands above or below the line."""
    one = lambda subset, column: F.array(F.struct(F.lit(subset).alias("subset"), F.col(column).alias("class")))
    faces = F.transform("flags", lambda x: F.struct(F.lit("font_typeface").alias("subset"), x.alias("class")))
    pairs = F.concat(faces, one("font_family", "ff"), one("font_size", "fs"), one("font_style", "style"))
    raised = F.arrays_overlap("flags", F.array(F.lit("superscript"), F.lit("subscript")))
    return runs.withColumn("features", F.filter(pairs, lambda x: x["class"].isNotNull())).withColumn("tag", F.when(raised, "token"))


def abby_paragraphs(runs: DataFrame) -> DataFrame:
    """(doc_id, page, par, text, spans): runs in order, lines with a space between unless a hyphen ends them; items begin with "- ".

    spans has the text with its markup: set spaces at either end of a run, hyphens, and the tag of raised or lowered runs.
    """
    at = F.struct("line", "run", "text", "hyphen", "list_item", "lead", "trail", "tag")
    gathered = abby_features(runs).groupBy("doc_id", "page", "par").agg(F.array_sort(F.collect_list(at)).alias("rs"))
    last = lambda i: F.get("rs", i + 1)
    between = lambda r, i: F.when(last(i)["line"].isNotNull() & (last(i)["line"] != r["line"]) & r["hyphen"].isNull(), " ").otherwise("")
    piece = F.transform("rs", lambda r, i: F.concat(r["lead"], r["text"], r["trail"], between(r, i)))
    text = F.regexp_replace(F.trim(F.array_join(piece, "")), r"\s+", " ")
    part = lambda kind, said, tag: F.struct(F.lit("current").alias("layer"), F.lit(kind).alias("kind"), said.alias("text"), tag.alias("tag"))
    none = F.lit(None).cast("string")
    item = F.col("rs")[0]["list_item"] & ~text.startswith("- ")
    opening = F.when(item, F.array(part("text", F.lit("- "), none))).otherwise(F.array().cast("array<struct<layer: string, kind: string, text: string, tag: string>>"))
    parts = F.flatten(F.transform("rs", lambda r, i: F.array(part("t-hspace", r["lead"], none), part("text", r["text"], r["tag"]), part("t-hbr", r["hyphen"], none), part("t-hspace", r["trail"], none), part("text", between(r, i), none))))
    spans = F.concat(opening, F.filter(parts, lambda x: x["text"] != ""))
    return gathered.select("doc_id", "page", "par", F.when(item, F.concat(F.lit("- "), text)).otherwise(text).alias("text"), spans.alias("spans"))


HOCR = "doc_id string, par int, par_id string, line int, line_id string, word_id string, ord int, text string"


#: What HTML and XML read in different ways, or XML can't read by itself.
HOCR_ODD = re.compile(rb"\r|<!\[CDATA\[|<!ENTITY|&(?!(?:amp|lt|gt|quot|apos|#39|#34);)")


class HocrWords:
    """The words of an hOCR page, from its tags and texts in order."""

    empty, kinds = frozenset(("br", "img", "meta", "link", "hr", "input")), frozenset(("ocrx_word", "ocr_word"))

    def __init__(self):
        self.stack, self.inside, self.pages, self.doc_id, self.words = [], 0, 0, None, []
        self.par = self.line = -1
        self.par_id = self.line_id = None

    def start(self, tag, own):
        kind = own.get("class") or ""
        word = kind in self.kinds
        if tag == "div" and kind == "ocr_page":
            self.pages += 1
            found = re.search(r'image\s+"?([^";]+)', own.get("title") or "")
            self.doc_id = stem(re.sub(r"\.\w+$", "", found[1])) if found else None
        elif tag == "p":
            self.par, self.line = self.par + 1, -1
            self.par_id = own.get("id")
        elif kind == "ocr_line":
            self.line += 1
            self.line_id = own.get("id")
        elif word:
            self.words.append([self.par, self.par_id, self.line, self.line_id, own.get("id"), kind, ""])
        if tag not in self.empty:
            self.stack.append((tag, word))
            self.inside += word

    def end(self, tag):
        while self.stack:
            last, word = self.stack.pop()
            self.inside -= word
            if last == tag:
                break

    def data(self, text):
        if self.inside:
            self.words[-1][-1] += text


def hocr_words(data: bytes) -> HocrWords:
    """What is well-formed XML is read as such, which is several times faster, and all else as HTML; where the two differ it is HTML."""
    from xml.parsers import expat

    if not HOCR_ODD.search(data):
        words, parser = HocrWords(), expat.ParserCreate("utf-8")
        parser.buffer_text = True
        parser.StartElementHandler = lambda tag, own: words.start(tag.lower(), {k.lower(): v for k, v in own.items()})
        parser.EndElementHandler = lambda tag: words.end(tag.lower())
        parser.CharacterDataHandler = words.data
        try:
            parser.Parse(data, True)
            return words
        except expat.ExpatError:
            pass
    return hocr_words_html(data)


def hocr_words_html(data: bytes) -> HocrWords:
    from html.parser import HTMLParser

    words = HocrWords()

    class Reader(HTMLParser):
        def handle_starttag(self, tag, pairs):
            words.start(tag, {k: v or "" for k, v in pairs})

        def handle_endtag(self, tag):
            words.end(tag)

        def handle_data(self, text):
            words.data(text)

    Reader().feed(data.decode("utf-8", "replace"))
    return words


def hocr(path: str, data: bytes):
    """Word rows of an hOCR page: ocrx_word, or ocr_word where a line has none; exactly one ocr_page is expected."""
    reader = hocr_words(data)
    if reader.pages != 1:
        raise ValueError(f"{reader.pages} pages where one is expected")
    exact = {(w[0], w[2]) for w in reader.words if w[5] == "ocrx_word"}
    kept = [w for w in reader.words if (w[5] == "ocrx_word" or (w[0], w[2]) not in exact) and w[6].strip()]
    return [{"doc_id": reader.doc_id or stem(path), "par": p, "par_id": pi, "line": n, "line_id": li, "word_id": wi, "ord": k, "text": t.strip()} for k, (p, pi, n, li, wi, _, t) in enumerate(kept)]


def hocr_paragraphs(words: DataFrame) -> DataFrame:
    """(doc_id, par, text, words: array of struct(word_id, text, start)) of paragraphs that have words."""
    from glossmill.operators.tree import offsets

    placed = offsets(words.withColumn("word", F.col("text")), ["doc_id", "par"], "ord")
    gathered = placed.groupBy("doc_id", "par").agg(F.array_sort(F.collect_list(F.struct("ord", "word_id", "text", "start"))).alias("ws"))
    return gathered.select("doc_id", "par", F.array_join("ws.text", " ").alias("text"), F.transform("ws", lambda w: F.struct(w["word_id"].alias("word_id"), w["text"].alias("text"), w["start"].alias("start"))).alias("words"))


#: Elements of HTML that begin a unit and the unit's tag, those that end one as well, and those without text.
HTML_UNITS = {"p": "p", "h1": "head", "h2": "head", "h3": "head", "h4": "head", "h5": "head", "h6": "head", "footer": "note", "aside": "note", "li": "item", "td": "cell", "th": "cell", "caption": "caption", "figcaption": "caption", "blockquote": "quote", "pre": "p", "div": "div"}
HTML_BLOCKS = ("article", "section", "main", "header", "nav", "ul", "ol", "dl", "dt", "dd", "table", "tr", "form", "body", "html", "hr", "address", "figure")
HTML_SILENT = ("script", "style", "template", "noscript", "head", "svg")


def html(path: str, data: bytes):
    """Node rows of a web page: paragraphs, heads, notes, items and cells with the text that a reader sees.

    Inner tags go, <br> is a space, entities are characters; scripts, styles
    and comments have no text.  A unit ends where its element does, or where
    a block begins or ends.  A note's text is in a paragraph below it.  The
    title is an attribute of the root.
    """
    from html.parser import HTMLParser

    nodes = Nodes(stem(path))
    root = nodes.add("text")

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.silent, self.title, self.unit, self.parts, self.notes = [], None, None, [], 0

        def close_unit(self):
            text = " ".join("".join(self.parts).split())
            tag, self.unit, self.parts = self.unit, None, []
            if not text or not tag:
                return
            if tag == "note" or self.notes and tag == "p":
                note = nodes.add("note", root, texts={"current": text})
                nodes.add("p", note, texts={"current": text})
            else:
                nodes.add(tag, root, texts={"current": text})

        def handle_starttag(self, tag, pairs):
            if tag == "title" and self.title is None:
                self.title = ""
            elif tag in HTML_SILENT:
                self.silent.append(tag)
            elif tag in HTML_UNITS or tag in HTML_BLOCKS:
                self.close_unit()
                self.unit = HTML_UNITS.get(tag)
                self.notes += tag in ("footer", "aside")
                if tag == "body":
                    self.silent.clear()
            elif tag == "br":
                self.parts.append(" ")

        def handle_startendtag(self, tag, pairs):
            if tag == "br":
                self.parts.append(" ")

        def handle_endtag(self, tag):
            if tag == "title":
                root["attrs"] = {"title": " ".join((self.title or "").split())}
            elif tag in HTML_SILENT and tag in self.silent:
                del self.silent[self.silent.index(tag) :]
            elif tag in HTML_UNITS or tag in HTML_BLOCKS:
                self.close_unit()
                self.notes -= tag in ("footer", "aside") and self.notes > 0

        def handle_data(self, text):
            if self.title is not None and not root["attrs"]:
                self.title += text
            elif not self.silent:
                self.parts.append(text)

    reader = Reader()
    reader.feed(data.decode("utf-8", "replace"))
    reader.close()
    reader.close_unit()
    return nodes.rows


def proceedings(path: str, data: bytes, split: bool = True, prefix: str = ""):
    """Node rows of parliamentary proceedings; with split each topic is a document of its own."""
    root = root_of(data)
    name = prefix + next((x.text for x in root.iter() if local(x) == "identifier" and x.text), stem(path))
    out = []

    def text(element) -> str:
        return " ".join("".join(element.itertext()).split())

    def known(value: str | None) -> str:
        return value or "unknown"

    def paragraph(nodes: Nodes, element, parent) -> None:
        own = attributes(element)
        body = [element.text or ""]
        notes, entities = [], []
        for child in element:
            kind = local(child)
            if kind == "note":
                notes.append(child)
            elif kind == "tagged-entity":
                entities.append(child)
                body.append("".join(child.itertext()))
            else:
                body.append("".join(child.itertext()))
            body.append(child.tail or "")
        row = nodes.add("p", parent, own.get("id"), own.get("type"), texts={"OCR": " ".join("".join(body).split())})
        for entity in entities:
            e = attributes(entity)
            nodes.add("entity", row, None, known(e.get("type")), texts={"OCR": text(entity)}, attrs={k: known(e.get(k)) for k in ("reference", "source", "member-ref", "party-ref")})
        for note in notes:
            nodes.add("note", row, attributes(note).get("id"), "note", texts={"OCR": text(note)})

    def visit(nodes: Nodes, element, parent) -> None:
        kind, own = local(element), attributes(element)
        if kind == "p":
            paragraph(nodes, element, parent)
        elif kind in ("speech", "scene", "stage-direction", "vote", "topic", "proceedings", "block", "section", "division", "parliamentary-document", "members", "about", "information", "signed", "sub-block"):
            row = nodes.add("div", parent, own.get("id"), own.get("type") or kind, attrs={k: v for k, v in own.items() if k in SPEAKER_FEATURES})
            for key in SPEAKER_FEATURES:
                if key in own:
                    nodes.add("feat", row, None, own[key], attrs={"subset": key})
            if own.get("title"):
                nodes.add("head", row, texts={"OCR": own["title"]})
            if not len(element) and text(element):
                nodes.add("p", row, texts={"OCR": text(element)})
            for child in element:
                visit(nodes, child, row)
        elif kind in ("title", "heading", "header", "h"):
            nodes.add("head", parent, own.get("id"), texts={"OCR": text(element)})
        elif kind in ("chair", "pagebreak", "break"):
            nodes.add("br" if kind != "chair" else "feat", parent, own.get("id"), known(own.get("speaker") or own.get("originalpagenr")), attrs={k: known(v) for k, v in own.items()})
        elif kind and text(element):
            nodes.add("p", parent, own.get("id"), kind, texts={"OCR": text(element)})

    bodies = [x for x in root.iter() if local(x) in ("proceedings", "parliamentary-document")]
    topics = [x for body in bodies for x in body if local(x) == "topic"]
    for k, topic in enumerate(topics if split else []):
        nodes = Nodes(prefix + (attributes(topic).get("id") or f"{name}.{k + 1}"))
        visit(nodes, topic, nodes.add("text"))
        out += nodes.rows
    if not split or not topics:
        nodes = Nodes(name)
        base = nodes.add("text")
        for body in bodies:
            visit(nodes, body, base)
        out += nodes.rows
    return out


def read(files_: DataFrame, kind: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Rows of files (path, content) of a format by name, or only these columns of them; see files.good() and files.quarantine()."""
    readers = {"annotated": (annotated_rows, f"{NODES}, leaf boolean"), "header": (header, HEADER), "page": (page, REGIONS), "alto": (alto, ALTO), "didl": (didl, DIDL), "abby": (abby, RUNS), "hocr": (hocr, HOCR), "html": (html, NODES), "proceedings": (proceedings, NODES)}
    parser, schema = readers[kind]
    columns = columns or (NODE_COLUMNS if kind == "annotated" else None)  # leaf is only for those who ask
    return files.parsed(files_, (lambda p, d: parser(p, d, **options)) if options else parser, schema, columns)


ESCAPED = re.compile('[&<>"\r\n\t]')
IN_TEXT = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
IN_ATTRIBUTE = IN_TEXT | str.maketrans({'"': "&quot;", "\r": "&#13;", "\n": "&#10;", "\t": "&#09;"})


def marked(t, spans) -> None:
    """Puts parts of a text with their markup into an element."""
    import xml.etree.ElementTree as ET

    last = None
    for x in spans:
        if x["kind"] != "text":
            last = ET.SubElement(t, x["kind"])
            last.text = x["text"] or None
        elif x["tag"]:
            last = ET.SubElement(t, "t-style", {"tag": x["tag"]})
            last.text = x["text"]
        elif last is None:
            t.text = (t.text or "") + x["text"]
        else:
            last.tail = (last.tail or "") + x["text"]


def own_attributes(node_id, cls, set_, space, attrs) -> dict[str, str]:
    """A node's attributes as they are written."""
    return {k: v for k, v in (("xml:id", node_id), ("class", cls), ("set", set_)) if v is not None} | ({} if space is None or space else {"space": "no"}) | {k: v for k, v in attrs.items() if v is not None}


def nodes_xml(rows: list[tuple]) -> str | None:
    """Nodes (node_id, parent_id, label, tag, cls, set, space, texts, attrs, spans) in order as XML; None where a tree is needed to say it.

    That is so if an id comes twice, a node's parent is closed already, or a name has a namespace.
    """
    import xml.etree.ElementTree as ET

    parts, seen, special = [], set(), ESCAPED.search
    stack, empty = [], False  # (id, end tag) of open elements; whether the last has nothing in it yet
    put = parts.append
    for node_id, parent_id, _, tag, cls, set_, space, texts, attrs, spans in rows:
        if node_id in seen or not tag or "{" in tag:
            return None
        if parent_id is not None and parent_id in seen:
            while stack and stack[-1][0] != parent_id:
                put(" />" if empty else stack[-1][1])
                stack.pop()
                empty = False
            if not stack:
                return None
        else:
            while stack:
                end = stack.pop()[1]
                put(" />" if empty else end)
                empty = False
        if empty:
            put(">")
        seen.add(node_id)
        if node_id is not None and cls is None and set_ is None and space is not False and not attrs:
            put(f'<{tag} xml:id="{node_id.translate(IN_ATTRIBUTE) if special(node_id) else node_id}"')
        else:
            put(f"<{tag}")
            for k, v in own_attributes(node_id, cls, set_, space, attrs).items():
                if "{" in k:
                    return None
                put(f' {k}="{v.translate(IN_ATTRIBUTE) if special(v) else v}"')
        stack.append((node_id, f"</{tag}>"))
        empty = not texts
        if texts:
            put(">")
            for layer, text in sorted(texts.items()):
                if spans and (inside := [x for x in spans if x["layer"] == layer]):
                    if any("{" in x["kind"] for x in inside):
                        return None
                    t = ET.Element("t", {} if layer == "current" else {"class": layer})
                    marked(t, inside)
                    put(ET.tostring(t, encoding="unicode"))
                    continue
                put("<t" if layer == "current" else f'<t class="{layer.translate(IN_ATTRIBUTE)}"')
                put(f">{text.translate(IN_TEXT) if special(text) else text}</t>" if text else " />")
    while stack:
        end = stack.pop()[1]
        put(" />" if empty else end)
        empty = False
    return "".join(parts)


def document_xml(doc_id: str, rows: list[tuple], root_tag: str, given: dict) -> str | None:
    """A document as XML from its rows, those of the header first; None if it has no others."""
    import xml.etree.ElementTree as ET

    root, made, at = ET.Element(root_tag, {"xml:id": doc_id} | given), {}, 0
    for at, (_, _, label, tag, *_, texts, attrs, _) in enumerate(rows):  # noqa: B007
        if not label.startswith("!"):
            break
        if label == "!":
            root.tag = tag
            root.attrib.update(attrs | {"xml:id": doc_id} | given)
            made["!"] = root
            continue
        element = made[label] = ET.SubElement(made.get(label.rpartition("/")[0], root), tag, attrs)
        element.text, element.tail = texts.get("text"), texts.get("tail")
    else:
        return None
    rows = rows[at:]
    body = nodes_xml(rows)
    if body is not None:
        said = ET.tostring(root, encoding="unicode")
        if said.endswith(" />"):
            return f"{said[:-3]}>{body}</{said[1:].split(None, 1)[0]}>"
        head, _, end = said.rpartition("</")
        return f"{head}{body}</{end}"
    for node_id, parent_id, _, tag, cls, set_, space, texts, attrs, spans in rows:
        element = made[node_id] = ET.SubElement(made.get(parent_id, root), tag, own_attributes(node_id, cls, set_, space, attrs))
        for layer, text in sorted(texts.items()):
            t = ET.SubElement(element, "t", {} if layer == "current" else {"class": layer})
            if inside := [x for x in spans if x["layer"] == layer]:
                marked(t, inside)
            else:
                t.text = text
    return ET.tostring(root, encoding="unicode")


def to_xml(nodes: DataFrame, root_tag: str = "document", namespace: str | None = None, headers: DataFrame | None = None) -> DataFrame:
    """(doc_id, xml): documents written as annotated text from their nodes, with markup of texts; a document's tree must fit a task.

    headers give a document its root, with namespace and attributes, and its
    metadata; those of documents without nodes aren't written.
    """

    def plain(column) -> list:
        """A column's values; maps as dictionaries and lists, nulls as empty ones of their kind."""
        import pyarrow as pa

        flat = lambda x: x.to_numpy(zero_copy_only=False).tolist()  # noqa: E731  a tenth of what to_pylist takes
        if not pa.types.is_map(column.type) and not pa.types.is_list(column.type):
            return flat(column)
        at = flat(column.offsets)
        if at[-1] == at[0]:
            return [{} if pa.types.is_map(column.type) else []] * len(column)
        if pa.types.is_list(column.type):
            values = column.values.to_pylist()
            return [values[a:b] for a, b in zip(at, at[1:])]  # noqa: B905
        keys, items = flat(column.keys), flat(column.items)
        return [dict(zip(keys[a:b], items[a:b], strict=True)) for a, b in zip(at, at[1:])]  # noqa: B905

    given = {"xmlns": namespace} if namespace else {}

    def write(batches):
        import gc

        import pyarrow as pa

        now, waiting, done = None, [], []

        def finished():
            if waiting and (made := document_xml(now, waiting, root_tag, given)) is not None:
                done.append((now, made))
            waiting.clear()

        def taken():
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], ["doc_id", "xml"])
            done.clear()
            return out

        gc.disable()  # rows live until their document is written, and leave no cycles
        try:
            for batch in batches:  # rows of one document come one after the other, by label
                ids, *others = map(plain, batch.columns)
                for doc_id, row in zip(ids, zip(*others, strict=True), strict=True):
                    if doc_id != now:
                        finished()
                        now = doc_id
                    waiting.append(row)
                yield taken()
            finished()
            yield taken()
        finally:
            gc.enable()

    own = ["doc_id", "node_id", "parent_id", "label", "tag", "cls", "set", "space", "texts", "attrs", "spans"]
    rows = nodes.select(*own)
    if headers is not None:
        kinds, texts = dict(nodes.dtypes), F.map_filter(F.create_map(F.lit("text"), F.col("text"), F.lit("tail"), F.col("tail")), lambda k, v: v.isNotNull())
        made = headers.withColumn("texts", texts)
        rows = rows.union(made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in own]))
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "label").mapInArrow(write, "doc_id string, xml string")


def units_to_nodes(units: DataFrame, doc: str = "doc_id", order: str = "ord", tag: str | None = None) -> DataFrame:
    """Node rows of documents that are a sequence of blocks (doc, order, text, tag unless given, and spans if there are any): a text with the blocks below it."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    root = F.concat(F.col(doc), F.lit(".text"))
    name = F.lit(tag) if tag else F.col("tag")
    empty = ["cast(null as string) as cls", "cast(null as string) as `set`", "cast(null as string) as lang", "true as space"]
    attrs, none = "cast(map() as map<string,string>) as attrs", "cast(array() as array<struct<layer: string, kind: string, text: string, tag: string>>)"
    own = "spans" if "spans" in units.columns else f"{none} as spans"
    blocks = units.select(F.col(doc).cast("string").alias("doc_id"), F.concat(root, F.lit("."), name, F.lit("."), at).alias("node_id"), root.alias("parent_id"), F.array(F.lit("text")).alias("path"), F.array(root).alias("path_ids"), at.cast("long").alias("ord"), F.lit(2).alias("depth"), name.alias("tag"), "text", *[c for c in ("spans",) if c in units.columns])
    blocks = blocks.selectExpr("doc_id", "node_id", "parent_id", "path", "path_ids", "ord", "depth", "tag", *empty, "map('current', text) as texts", attrs, own, "concat('00000000/', lpad(lower(hex(ord)), 8, '0')) as label")
    tops = units.select(F.col(doc).cast("string").alias("doc_id")).distinct().selectExpr("doc_id", "concat(doc_id, '.text') as node_id", "cast(null as string) as parent_id", "cast(array() as array<string>) as path", "cast(array() as array<string>) as path_ids", "0L as ord", "1 as depth", "'text' as tag", *empty, "cast(map() as map<string,string>) as texts", attrs, f"{none} as spans", "'00000000' as label")
    return tops.union(blocks).select(*[c.strip().split(" ")[0] for c in files.split_schema(NODES)])
