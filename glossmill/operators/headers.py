"""What documents say of themselves: annotations that they declare, processors they went through, metadata.

A header is rows (doc_id, label, tag, attrs, text, tail), one for each element
from the root, whose label is !, to the last below `metadata`; labels order
and nest them as those of nodes do (see edits), and sort before all nodes.
Operators that add or drop annotations add or drop declarations with them.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossmill.operators.edits import digits
from glossmill.session import stored

HEADER = "doc_id string, label string, tag string, attrs map<string,string>, text string, tail string"
#: The types under which elements are declared, where they aren't called as the elements are.
TYPES = {"w": "token", "s": "sentence", "p": "paragraph", "str": "string", "div": "division", "br": "linebreak", "t": "text", "item": "list", "row": "table", "cell": "table", "def": "definition", "ex": "example", "utt": "utterance"}

def _section(tag: str, depth: int) -> Column:
    """Whether a row is of that tag and so deep."""
    return (F.col("tag") == tag) & (F.size(F.split("label", "/")) == depth)


def _declared() -> Column:
    """Whether a row is a declaration."""
    return F.col("tag").endswith("-annotation") & (F.size(F.split("label", "/")) == 4)


def _above() -> Column:
    """The label of the element around."""
    return F.expr("substring(label, 1, length(label) - length(substring_index(label, '/', -1)) - 1)")


def _rows(rows: DataFrame, label: Column, tag: Column, attrs: dict[str, Column] | None = None, text: Column | None = None) -> DataFrame:
    """Header rows, attributes without value left out."""
    none = F.lit(None).cast("string")
    said = F.map_filter(F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull()) if attrs else F.create_map().cast("map<string,string>")
    return rows.select("doc_id", label.alias("label"), tag.alias("tag"), said.alias("attrs"), (none if text is None else text).alias("text"), none.alias("tail"))


def annotation_type(tag: Column) -> Column:
    """The type under which an element is declared."""
    known = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, tag), tag)


def declarations(headers: DataFrame) -> DataFrame:
    """(doc_id, type, set, processors) of declared annotations; processors are the ids of those who made them, in order."""
    own = headers.where(_declared()).select("doc_id", "label", F.regexp_replace("tag", "-annotation$", "").alias("type"), F.col("attrs")["set"].alias("set"))
    makers = headers.where("tag = 'annotator'").select("doc_id", _above().alias("label"), F.struct("label", F.col("attrs")["processor"].alias("id")).alias("m"))
    listed = makers.groupBy("doc_id", "label").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    return own.join(listed, ["doc_id", "label"], "left").select("doc_id", "type", "set", F.coalesce(F.col("ms.id"), F.array().cast("array<string>")).alias("processors"))


def processors(headers: DataFrame) -> DataFrame:
    """(doc_id, id, name, version, command, begun) of the processors of documents; those inside others are rows as well."""
    said = lambda key, name: F.col("attrs")[key].alias(name)
    return headers.where("tag = 'processor'").select("doc_id", F.coalesce(F.col("attrs")["xml:id"], F.col("attrs")["id"]).alias("id"), said("name", "name"), said("version", "version"), said("command", "command"), said("begindatetime", "begun"))


def metadata(headers: DataFrame) -> DataFrame:
    """(doc_id, name, value) of documents' metadata."""
    return headers.where(_section("meta", 3)).select("doc_id", F.col("attrs")["id"].alias("name"), F.trim("text").alias("value"))


def ensured(headers: DataFrame, docs: DataFrame, root: str = "document") -> DataFrame:
    """headers, with the sections that a document of docs lacks: root, metadata, annotations, provenance.

    They are written into the shared folder, since all that is added next looks at them several times.
    """
    at = [F.max(F.when(_section(tag, depth), F.col("label"))).alias(tag) for tag, depth in (("metadata", 2), ("annotations", 3), ("provenance", 3))]
    have = headers.groupBy("doc_id").agg(F.max(F.col("label") == "!").alias("root"), *at)
    spots = docs.select("doc_id").where("doc_id is not null").distinct().join(have, "doc_id", "left")
    top = F.coalesce("metadata", F.lit("!/00000000"))
    need = [("root", F.lit("!"), root), ("metadata", top, "metadata"), ("annotations", F.concat(top, F.lit("/!0")), "annotations"), ("provenance", F.concat(top, F.lit("/!1")), "provenance")]
    lacking = F.array(*[F.when(F.col(known).isNull(), F.struct(label.alias("label"), F.lit(tag).alias("tag"))) for known, label, tag in need])
    each = spots.select("doc_id", F.explode(F.filter(lacking, lambda x: x.isNotNull())).alias("x"))
    attrs = {"type": F.when(F.col("x.tag") == "metadata", F.lit("native"))}
    return stored(headers.union(_rows(each, F.col("x.label"), F.col("x.tag"), attrs)), "headers")


def processed(headers: DataFrame, docs: DataFrame, name: str, version: str = "", command: str = "", begun: str | None = None) -> DataFrame:
    """headers with a processor for each document of docs, the last one; its id is its name and how many times that came."""
    full = ensured(headers, docs)
    mine = F.col("attrs")["name"] == name
    counts = full.groupBy("doc_id").agg(F.max(F.when(_section("provenance", 3), F.col("label"))).alias("spot"), F.count(F.when(_section("processor", 4), 1)).alias("k"), F.count(F.when((F.col("tag") == "processor") & mine, 1)).alias("had"))
    spots = counts.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    attrs = {"xml:id": F.concat(F.lit(f"{name}."), (F.col("had") + 1).cast("string")), "name": F.lit(name), "version": F.lit(version or None).cast("string"), "command": F.lit(command or None).cast("string"), "begindatetime": F.lit(begun).cast("string")}
    return full.union(_rows(spots, F.concat("spot", F.lit("/~"), digits(F.col("k"))), F.lit("processor"), attrs))


def declared(headers: DataFrame, rows: DataFrame, name: str, again: bool = True) -> DataFrame:
    """headers, in which the annotations rows (doc_id, type, set) are declared as made by the last processor of that name.

    Of what is declared already the processor becomes one more maker, unless
    it is one or again says no.  Rows without type are passed over.
    """
    wanted = rows.where("type is not null and doc_id is not null").select("doc_id", "type", "set").distinct()
    full = ensured(headers, wanted)
    maker = full.where("tag = 'processor'").where(F.col("attrs")["name"] == name).groupBy("doc_id").agg(F.max_by(F.coalesce(F.col("attrs")["xml:id"], F.col("attrs")["id"]), "label").alias("maker"))
    sections = full.groupBy("doc_id").agg(F.max(F.when(_section("annotations", 3), F.col("label"))).alias("spot"), F.count(F.when(_declared(), 1)).alias("k"))
    known = full.where(_declared()).select("doc_id", F.regexp_replace("tag", "-annotation$", "").alias("type"), F.col("attrs")["set"].alias("_set"), "label")
    met = wanted.join(known.withColumnRenamed("doc_id", "_doc").withColumnRenamed("type", "_type"), (F.col("doc_id") == F.col("_doc")) & (F.col("type") == F.col("_type")) & F.col("set").eqNullSafe(F.col("_set")), "left").select("doc_id", "type", "set", "label")
    listed = met.where("label is null").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("type", "set"))).alias("ds"))  # a document's few declarations
    new = listed.join(sections, "doc_id").join(maker, "doc_id", "left").select("doc_id", "maker", "spot", "k", F.posexplode("ds").alias("i", "d"))
    at = F.concat("spot", F.lit("/~"), digits(F.col("k") + F.col("i")))
    out = full.union(_rows(new, at, F.concat("d.type", F.lit("-annotation")), {"set": F.col("d.set")}))
    out = out.union(_rows(new.where("maker is not null"), F.concat(at, F.lit("/00000000")), F.lit("annotator"), {"processor": F.col("maker")}))
    if not again:
        return out
    makers = full.where("tag = 'annotator'").groupBy("doc_id", _above().alias("label")).agg(F.collect_set(F.col("attrs")["processor"]).alias("makers"))
    more = met.where("label is not null").join(makers, ["doc_id", "label"], "left").join(maker, "doc_id").where("makers is null or not array_contains(makers, maker)")
    place = F.concat("label", F.lit("/~"), digits(F.coalesce(F.size("makers"), F.lit(0))))
    return out.union(_rows(more, place, F.lit("annotator"), {"processor": F.col("maker")}))


def undeclared(headers: DataFrame, drop: list[tuple[str, str]]) -> DataFrame:
    """headers without the declarations of (type, set) pairs, types as declared or as elements are called; an empty set stands for all."""
    own, gone = F.regexp_replace("tag", "-annotation$", ""), F.lit(False)
    for kind, name in drop:
        gone = gone | (own == TYPES.get(kind, kind)) & (F.lit(name == "") | F.col("attrs")["set"].eqNullSafe(F.lit(name)))
    spots = headers.where(_declared() & gone).select(F.col("doc_id").alias("_doc"), F.col("label").alias("_at"))
    same = [F.col("doc_id") == F.col("_doc"), F.substring_index("label", "/", 4) == F.col("_at")]
    return headers.join(spots, same, "left_anti")


def described(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """headers with metadata rows (doc_id, name, value); what a document has by a name is replaced, and rows without name or value are passed over."""
    wanted = rows.where("name is not null and value is not null").groupBy("doc_id", "name").agg(F.min("value").alias("value"))
    full = ensured(headers, wanted)
    named = wanted.select(F.col("doc_id").alias("_doc"), F.col("name").alias("_name"))
    kept = full.withColumn("_is", F.when(_section("meta", 3), F.col("attrs")["id"])).join(named, [F.col("doc_id") == F.col("_doc"), F.col("_is") == F.col("_name")], "left_anti").drop("_is")
    spots = full.where(_section("metadata", 2)).groupBy("doc_id").agg(F.max("label").alias("spot"))
    place = F.concat("spot", F.lit("/~"), F.lower(F.hex(F.encode("name", "UTF-8"))))
    return kept.union(_rows(wanted.join(spots, "doc_id"), place, F.lit("meta"), {"id": F.col("name")}, F.col("value")))


def types_of(nodes: DataFrame) -> DataFrame:
    """(doc_id, type, set) of all that stands in documents and has to be declared."""
    own = nodes.where(~F.col("tag").isin("text", "new", "original", "current", "suggestion", "alt", "feat"))
    return own.select("doc_id", annotation_type(F.col("tag")).alias("type"), "set").distinct()
