"""Documents as flat nodes: selection by tag, text layers, annotations, tokens, reading order, hyphens.

nodes: doc_id, node_id, parent_id, path (tags of all ancestors), path_ids (their ids), ord (order in
the document), depth, tag, cls, set, lang, space, texts (layer to text), attrs, spans (the parts of
texts that have markup inside, in order), label (what ord says, with room for more: see operators.edits).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossmill.functions import strings

NODES = "doc_id string, node_id string, parent_id string, path array<string>, path_ids array<string>, ord long, depth int, tag string, cls string, set string, lang string, space boolean, texts map<string,string>, attrs map<string,string>, spans array<struct<layer: string, kind: string, text: string, tag: string>>, label string"


def select(nodes: DataFrame, tags: list[str], skip: list[str] = (), top: bool = True) -> DataFrame:
    """Nodes of each tag, tags taken one by one; with `top` none inside a node of the same tag, and none inside or of a tag to skip."""
    inside = lambda names: F.exists("path", lambda x: x.isin(list(names)))
    kept = nodes.where(F.col("tag").isin(list(tags)))
    if skip:
        kept = kept.where(~F.col("tag").isin(list(skip)) & ~inside(skip))
    return kept.where(~F.array_contains("path", F.col("tag"))) if top else kept


def default_units(nodes: DataFrame) -> DataFrame:
    """The sentences of documents that have any, else their paragraphs."""
    has = Window.partitionBy("doc_id")
    parts = nodes.where("tag in ('s', 'p')").withColumn("_s", F.max((F.col("tag") == "s").cast("int")).over(has))
    return parts.where("(_s = 1 and tag = 's') or (_s = 0 and tag = 'p')").drop("_s")


def layer(nodes: DataFrame, cls: str = "current") -> DataFrame:
    """Adds text, the text of one layer; null where a node lacks it."""
    return nodes.withColumn("text", F.col("texts")[cls])


def node_text(nodes: DataFrame, cls: str, tags: list[str], detokenise: bool = True) -> DataFrame:
    """(doc_id, node_id, text) of nodes of these tags: their own text in the layer, else that of the words below them, in order.

    detokenise leaves out the space after words that say so; else all have one.
    """
    own = nodes.where(F.col("tag").isin(tags))
    words = nodes.where("tag in ('w', 'str')").select("doc_id", "ord", "path_ids", F.col("texts")[cls].alias("t"), "space").where("t is not null")
    below = words.select("doc_id", F.explode("path_ids").alias("node_id"), F.struct("ord", "t", "space").alias("w")).groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    gap = lambda w: F.when(w["space"] | F.lit(not detokenise), F.lit(" ")).otherwise("")
    joined = F.rtrim(F.array_join(F.transform("ws", lambda w: F.concat(w["t"], gap(w))), ""))
    return own.join(below, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce(F.col("texts")[cls], joined).alias("text"))


def fix_text(nodes: DataFrame, cls: str) -> DataFrame:
    """Texts of structure in the layer replaced by those of the words below, where there are any; their markup goes."""
    texts = node_text(nodes.withColumn("texts", F.when(F.col("tag").isin("w", "str"), F.col("texts")).otherwise(F.map_filter("texts", lambda k, v: k != cls))), cls, ["s", "p", "head", "div", "note", "caption"]).withColumnRenamed("text", "_t")
    joined = nodes.join(texts.where("_t <> ''"), ["doc_id", "node_id"], "left")
    changes = F.col("_t").isNotNull() & F.map_contains_key("texts", F.lit(cls))
    new = F.map_concat(F.map_filter("texts", lambda k, v: k != cls), F.create_map(F.lit(cls), F.col("_t")))
    spans = F.when(changes, F.filter("spans", lambda x: x["layer"] != cls)).otherwise(F.col("spans"))
    return joined.withColumn("texts", F.when(changes, new).otherwise(F.col("texts"))).withColumn("spans", spans).select(*nodes.columns)


#: Structure whose text the node above it has to hold.
HELD = ("div", "p", "s", "w", "head", "note", "quote", "item", "caption", "cell")
#: What inconsistent() looks at.
HOLDING = ["doc_id", "node_id", "parent_id", "tag", "texts", "label", "leaf"]


def inconsistent(nodes: DataFrame, cls: str = "current") -> DataFrame:
    """(doc_id, node_id, text, child, child_text) of nodes whose text doesn't hold those of the nodes right below it, in order: the first that isn't there.

    White space counts for nothing.  A node's text begins with its children's,
    one after the other, if nothing else is between them; only where it
    doesn't is it searched from child to child.  A node meets its children in
    one shuffle; where a column leaf says that it has none, it isn't sent to meet any.
    """
    bare = lambda x: reduce(lambda y, c: F.replace(y, F.lit(c), F.lit("")), " \t\n\x0b\f\r", x)
    said = F.col("texts")[cls]
    child = F.when(F.col("tag").isin(*HELD) & F.col("parent_id").isNotNull() & (bare(said) != ""), F.struct("label", bare(said).alias("bare"), F.col("node_id").alias("child"), said.alias("child_text")))
    own, below = F.struct("node_id", said.alias("text"), F.lit(None).cast("struct<label: string, bare: string, child: string, child_text: string>").alias("c")), F.struct(F.col("parent_id").alias("node_id"), F.lit(None).cast("string").alias("text"), child.alias("c"))
    alone = F.coalesce("leaf", F.lit(False)) if "leaf" in nodes.columns else F.lit(False)
    sent = F.when(child.isNull(), F.when(~alone, F.array(own))).when(alone, F.array(below)).otherwise(F.array(own, below))
    both = nodes.where(said.isNotNull()).select("doc_id", F.explode(sent).alias("x")).select("doc_id", "x.*")
    met = both.groupBy("doc_id", "node_id").agg(F.max("text").alias("text"), F.array_sort(F.collect_list("c")).alias("children"))
    doubtful = met.where("text is not null").withColumn("whole", bare("text"))
    gathered = doubtful.where(~F.startswith("whole", F.array_join("children.bare", "")))
    start, step = "named_struct('at', 1, 'k', 0, 'lost', false)", "CASE WHEN acc.lost THEN acc WHEN locate(c.bare, whole, acc.at) = 0 THEN named_struct('at', acc.at, 'k', acc.k, 'lost', true) ELSE named_struct('at', locate(c.bare, whole, acc.at) + length(c.bare), 'k', acc.k + 1, 'lost', false) END"
    walked = gathered.withColumn("walk", F.expr(f"aggregate(children, {start}, (acc, c) -> {step})"))
    lost = walked.where("walk.lost").withColumn("lost", F.expr("children[walk.k]"))
    return lost.select("doc_id", "node_id", "text", "lost.child", "lost.child_text")


def drop_layers(nodes: DataFrame, cls: str, current: bool = False) -> DataFrame:
    """Text layers other than cls go; a word keeps its last one; with `current` what stays is renamed.  cls current changes nothing."""
    if cls == "current":
        return nodes
    left = F.map_filter("texts", lambda k, v: k == cls)
    kept = F.when((F.col("tag") == "w") & (F.size(left) == 0), F.col("texts")).otherwise(left)
    renamed = F.transform_keys(kept, lambda k, v: F.when(k == cls, "current").otherwise(k)) if current else kept
    return nodes.withColumn("texts", renamed)


def rename_layer(nodes: DataFrame, old: str, new: str) -> DataFrame:
    """The layer `old` under the name `new`; a layer that has that name goes."""
    rest = F.map_filter("texts", lambda k, v: k != new)
    return nodes.withColumn("texts", F.when(F.map_contains_key("texts", F.lit(old)), F.transform_keys(rest, lambda k, v: F.when(k == old, new).otherwise(k))).otherwise(F.col("texts")))


def drop_annotations(annotations: DataFrame, drop: list[tuple[str, str]]) -> DataFrame:
    """Annotations (…, type, set) without those of a (type, set) pair; an empty set stands for all."""
    gone: Column = F.lit(False)
    for kind, name in drop:
        gone = gone | ((F.col("type") == kind) & (F.lit(name == "") | F.col("set").eqNullSafe(F.lit(name))))
    return annotations.where(~gone)


def drop_tokens(nodes: DataFrame, cls: str) -> DataFrame:
    """Words and sentences below paragraphs go; a paragraph without text in the layer gets its words' text, joined."""
    texts = node_text(nodes, cls, ["p"]).withColumnRenamed("text", "_t")
    paragraphs = F.col("tag") == "p"
    inside = F.array_contains("path", "p") & F.col("tag").isin("s", "w")
    filled = nodes.where(~inside).join(texts, ["doc_id", "node_id"], "left")
    new = F.when(paragraphs & ~F.map_contains_key("texts", F.lit(cls)) & F.col("_t").isNotNull(), F.map_concat("texts", F.create_map(F.lit(cls), F.col("_t")))).otherwise(F.col("texts"))
    return filled.withColumn("texts", new).drop("_t")


def correction_view(corrections: DataFrame, handling: str = "current") -> DataFrame:
    """(…, text) of corrections (…, original, new): what is read as the text: current (the new), original, or either (the new, or where that has nothing the original)."""
    new, old = F.array_join("new", " "), F.array_join("original", " ")
    return corrections.withColumn("text", {"current": new, "original": old, "either": F.when(new != "", new).otherwise(old)}[handling])


def plain_text(nodes: DataFrame, cls: str = "current", tags: tuple = ("p", "head", "note")) -> DataFrame:
    """(doc_id, text) of each document with any: its top units' texts in order, blank lines between."""
    some = select(nodes, list(tags)).withColumn("t", F.col("texts")[cls]).where("t is not null and t <> ''")
    outer = some.where(~F.exists("path", lambda x: x.isin(list(tags))))
    joined = outer.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "t"))).alias("ts"))
    return joined.select("doc_id", F.array_join("ts.t", "\n\n").alias("text"))


def marked_text(spans: Column, restore: bool = False, honour_tags: bool = False) -> Column:
    """The text of an array of parts (kind, text, tag) in order.

    Line breaks are kept.  A hyphen at one counts only with `restore`, and
    then ends its line; a set space is one space, or as it is with `restore`.
    Parts marked as a token stand apart only with honour_tags.
    """

    def piece(x: Column) -> Column:
        own = F.coalesce(x["text"], F.lit(""))
        hyphen = F.concat(own, F.lit("\n")) if restore else F.lit("")
        space = F.when(own == "", " ").otherwise(own) if restore else F.lit(" ")
        said = F.when(x["kind"] == "t-hbr", hyphen).when(x["kind"] == "t-hspace", space).when(x["kind"] == "br", "\n").otherwise(own)
        return F.when(x["tag"] == "token", F.concat(F.lit(" "), said, F.lit(" "))).otherwise(said) if honour_tags else said

    return F.array_join(F.transform(spans, piece), "")


def spans_text(spans: DataFrame, restore: bool = False, honour_tags: bool = False) -> DataFrame:
    """(doc_id, node_id, text) from text parts (doc_id, node_id, ord, kind, text, tag); see marked_text."""
    gathered = spans.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "text", "tag"))).alias("ss"))
    return gathered.select("doc_id", "node_id", F.trim(marked_text(F.col("ss"), restore, honour_tags)).alias("text"))


#: Structure that holds blocks; in plain text what is outermost below it stands apart.
CONTAINERS = ("text", "div", "speech", "list", "figure", "table", "row", "tablehead", "event")
#: What document_text() looks at.
TEXTUAL = ["doc_id", "node_id", "path", "path_ids", "tag", "space", "texts", "spans", "label"]


def document_text(nodes: DataFrame, cls: str = "current", retain_tokens: bool = False, restore: bool = False, honour_tags: bool = False) -> DataFrame:
    """(doc_id, text) of each document with text in the layer, from its deepest texts: those of words, else of sentences, else of blocks.

    Words have a space between unless the first says no; with retain_tokens
    all have one.  Sentences have a space between, blocks a blank line.
    Strings that repeat a block's text are passed over.
    """
    marked = F.filter("spans", lambda x: x["layer"] == cls)
    own = F.when(F.size("spans") == 0, F.col("texts")[cls]).when(F.size(marked) > 0, marked_text(marked, restore, honour_tags)).otherwise(F.col("texts")[cls])
    said = nodes.where(~F.col("tag").isin("str", "morpheme", "entity", "feat")).withColumn("said", own).where("said is not null and said <> ''")
    # The first node from the top that is no container, else the node itself; arrays are looked through only where trees are deep.
    near = " ".join(f"WHEN get(path, {k}) NOT IN {CONTAINERS} THEN path_ids[{k}]" for k in range(4))
    far = f"coalesce(path_ids[get(filter(sequence(0, size(path) - 1), i -> path[i] NOT IN {CONTAINERS}), 0)], node_id)"
    placed = said.withColumn("block", F.expr(f"CASE {near} WHEN size(path) <= 4 THEN node_id ELSE {far} END"))
    gap = F.when((F.col("tag") == "w") & ~F.col("space") & F.lit(not retain_tokens) | F.col("said").endswith("\n"), "").otherwise(" ")
    gathered = placed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "block", F.concat("said", gap).alias("t")))).alias("ws"))  # its text is one value, too

    def inner(w, i):
        """Whether a text stands below: the next one in order does, then; rows of one label are those of documents that come twice."""
        under = lambda x: F.startswith(x["label"], F.concat(w["label"], F.lit("/")))
        after = F.get("ws", i + 1)
        return F.when(after["label"] == w["label"], F.exists(F.slice("ws", i + 2, F.size("ws")), under)).otherwise(F.coalesce(under(after), F.lit(False)))

    leaves = gathered.select("doc_id", F.filter("ws", lambda w, i: ~inner(w, i)).alias("ls"))
    first = F.filter(F.transform("ls", lambda x, i: F.when((i == 0) | (x["block"] != F.get("ls", i - 1)["block"]), i)), lambda i: i.isNotNull())
    firsts = leaves.withColumn("fs", first)
    block = lambda i, k: F.regexp_replace(F.array_join(F.transform(F.slice("ls", i + 1, F.coalesce(F.get("fs", k + 1), F.size("ls")) - i), lambda x: x["t"]), ""), " +$", "")
    return firsts.select("doc_id", F.array_join(F.transform("fs", block), "\n\n").alias("text"))


def compounds(nodes: DataFrame, layer_name: str = "current") -> DataFrame:
    """(doc_id, text, class, structure) of each morpheme with a feature of the subset compound, in document order."""
    features = nodes.where("tag = 'feat'").where(F.col("attrs")["subset"] == "compound").select("doc_id", F.col("parent_id").alias("node_id"), F.col("cls").alias("structure"))
    return nodes.where("tag = 'morpheme'").join(features, ["doc_id", "node_id"]).orderBy("doc_id", "ord").select("doc_id", F.col("texts")[layer_name].alias("text"), F.col("cls").alias("class"), "structure")


def without_existing(docs: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that the output hasn't got yet."""
    return docs.join(done.select(key).distinct(), key, "left_anti")


def reading_order(regions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds place to regions (doc_id, region_id, pos, read_index): those with an index together, in its order, where the first of them stands."""
    page = Window.partitionBy(key)
    first = F.min(F.when(F.col("read_index").isNotNull(), F.col("pos"))).over(page)
    anchor = F.when(F.col("read_index").isNotNull(), first).otherwise(F.col("pos"))
    return regions.withColumn("place", F.row_number().over(page.orderBy(anchor, F.coalesce("read_index", F.lit(-1)), "pos")) - 1)


def rejoin_hyphens(tokens: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """tokens (…, content, subs_type, subs_content) with the two parts of a broken word as one, at the place of the first.

    A first part without a second right after it, and a second without a first, stay as they are.
    """
    row = Window.partitionBy(*key).orderBy(order)
    follows, leads = F.lead("subs_type").over(row), F.lag("subs_type").over(row)
    marked = tokens.withColumn("_next", follows).withColumn("_prev", leads)
    whole = F.when((F.col("subs_type") == "HypPart1") & (F.col("_next") == "HypPart2"), F.col("subs_content"))
    gone = (F.col("subs_type") == "HypPart2") & F.col("_prev").eqNullSafe(F.lit("HypPart1"))
    return marked.where(~F.coalesce(gone, F.lit(False))).withColumn("word", F.coalesce(whole, F.col("content"))).drop("_next", "_prev")


def first_blocks(blocks: DataFrame, key: list[str], order: str = "ord") -> DataFrame:
    """Of blocks (or their lines) that share an id, those of the first; rows have key and order."""
    first = blocks.groupBy(*[F.col(k).alias(f"_{k}") for k in key]).agg(F.min(order).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return blocks.join(first, [*same, F.col(order) == F.col("_first")], "left_semi")


def offsets(words: DataFrame, key: list[str], order: str = "pos", word: str = "word", space: str | None = None, utf16: bool = False) -> DataFrame:
    """Adds start: where each word begins if all are written one after another, with a space unless it says no; in characters, or UTF-16 units."""
    width = (strings.utf16_length(F.col(word)) if utf16 else F.char_length(word)) + (F.when(F.col(space), 1).otherwise(0) if space else F.lit(1))
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return words.withColumn("start", F.coalesce(F.sum(width).over(before), F.lit(0)))
