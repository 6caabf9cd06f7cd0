"""Readers of the public sources: each returns (nodes, edges, xrefs) in the standard schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import concentration
from ..functions.names import clean_label, pipe_list, set_field, strip_brackets, strip_literal
from ..schemas import EDGES, NODES, XREFS, attrs_json, conform, empty

Frames = tuple[DataFrame, DataFrame, DataFrame]
# fixed values: synonym types of the food ontology, identifier kinds of the milk database
FOODON_TYPES = {"label": "label", "label (alternative)": "label_alt", "synonym (exact)": "exact", "synonym": "synonym", "synonym (narrow)": "narrow", "synonym (broad)": "broad", "taxon": "taxon"}
DMD_KEYS = {"ChEBI": "chebi", "PubChem": "pubchem_cid", "UniProt": "uniprot", "miRBase": "mirbase", "HMDB": "hmdb", "LIPID MAPS": "lipid_maps"}
FLAVOR_FIELDS = ("flavor_profile", "taste", "odor", "fooddb_flavor_profile", "super_sweet")
TABLES = ("nodes", "edges", "xrefs")
NO_STRINGS = "array<string>"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def _nodes(df: DataFrame, source: str, kind: str) -> DataFrame:
    return conform(df.withColumns({"source_id": F.lit(source), "node_type": F.lit(kind)}), NODES)


def _edges(df: DataFrame, source: str) -> DataFrame:
    return conform(df.withColumn("source_id", F.lit(source)), EDGES)


def _xrefs(df: DataFrame, source: str) -> DataFrame:
    return conform(df.withColumn("source_id", F.lit(source)), XREFS)


def _synonyms(names: Column, first: str = "label", rest: str = "synonym") -> Column:
    return F.transform(names, lambda _, i: F.when(i == 0, F.lit(first)).otherwise(F.lit(rest)))


def foodon(spark: SparkSession, path: str) -> Frames:
    """Synonym TSV (``?class ?parent ?type ?label``), one row per synonym and parent. Synonyms sort by type and text."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("class string, parent string, type string, label string").csv(path)
    rows = raw.select(strip_brackets(F.col("class")).alias("native_id"), strip_brackets(F.col("parent")).alias("parent"), F.coalesce(F.try_element_at(_map(FOODON_TYPES), F.col("type")), F.col("type")).alias("type"), strip_literal(F.col("label")).alias("label"))
    pairs = F.array_sort(F.collect_set(F.when(F.col("type").isNotNull(), F.struct("type", "label"))))
    nodes = rows.groupBy("native_id").agg(pairs.alias("s"))
    label = F.filter("s", lambda x: x["type"] == "label")
    nodes = nodes.select("native_id", F.lower(F.coalesce(F.get(label, 0)["label"], F.get("s", 0)["label"], F.lit(""))).alias("name"), F.col("s.label").alias("synonyms"), F.col("s.type").alias("synonym_types"), F.lit("{}").alias("raw_attrs"))
    edges = rows.filter("parent is not null").select(F.col("native_id").alias("head_native_id"), F.col("parent").alias("tail_native_id"), F.lit("is_a").alias("edge_type"), F.lit("{}").alias("raw_attrs")).distinct()
    return _nodes(nodes, "foodon", "class"), _edges(edges, "foodon"), empty(spark, XREFS)


def chebi(spark: SparkSession, folder: str) -> Frames:
    """``compounds.tsv`` (rows without a parent), ``names.tsv`` (English), ``relation.tsv`` (head is the final, tail the initial id)."""
    tsv = spark.read.option("sep", "\t").option("header", True).option("enforceSchema", False)
    compounds = tsv.option("encoding", "ISO-8859-1").schema("ID string, PARENT_ID string, NAME string, STAR int").csv(f"{folder}/compounds.tsv").filter("PARENT_ID is null or PARENT_ID = 'null'")
    names = tsv.schema("COMPOUND_ID string, TYPE string, NAME string, LANGUAGE string").csv(f"{folder}/names.tsv").filter("NAME is not null and LANGUAGE = 'en'")
    grouped = names.select("COMPOUND_ID", F.lower(F.trim("NAME")).alias("n"), F.lower(F.coalesce("TYPE", F.lit("synonym"))).alias("t")).groupBy("COMPOUND_ID", "n").agg(F.min("t").alias("t"))
    grouped = grouped.groupBy("COMPOUND_ID").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("s"))
    name = F.coalesce(F.nullif(F.lower(F.trim("NAME")), F.lit("null")), F.lit(""))
    joined = compounds.join(grouped, compounds.ID == grouped.COMPOUND_ID, "left").withColumn("name", name)
    own = F.when(F.col("name") != "", F.array(F.struct(F.col("name").alias("n"), F.lit("name").alias("t")))).otherwise(F.array().cast("array<struct<n:string,t:string>>"))
    every = F.concat(own, F.filter(F.coalesce("s", F.array().cast("array<struct<n:string,t:string>>")), lambda x: x["n"] != F.col("name")))
    nodes = joined.select(F.col("ID").alias("native_id"), "name", every.alias("e"), attrs_json(star=F.coalesce("STAR", F.lit(0))).alias("raw_attrs")).select("*", F.col("e.n").alias("synonyms"), F.col("e.t").alias("synonym_types"))
    relation = tsv.schema("ID string, TYPE string, INIT_ID string, FINAL_ID string").csv(f"{folder}/relation.tsv")
    edges = relation.select(F.col("FINAL_ID").alias("head_native_id"), F.col("INIT_ID").alias("tail_native_id"), F.replace(F.lower("TYPE"), F.lit(" "), F.lit("_")).alias("edge_type"), F.lit("{}").alias("raw_attrs"))
    return _nodes(nodes, "chebi", "compound"), _edges(edges, "chebi"), empty(spark, XREFS)


OWL_CLASS = (
    "`_rdf:about` string, `owl:deprecated` string, `rdfs:label` array<string>, `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>, "
    "`owl:equivalentClass` array<struct<`owl:Class`:struct<`owl:intersectionOf`:struct<`rdf:Description`:array<struct<`_rdf:about`:string>>>>,`rdf:Description`:array<struct<`_rdf:about`:string>>>>, "
    "`oboInOwl:hasDbXref` array<string>"
)


def cdno(spark: SparkSession, path: str) -> Frames:
    """OWL classes that are not deprecated; xrefs to ChEBI by equivalence and to nutrients by ``USDA_fdc_id:``."""
    raw = spark.read.format("xml").option("rowTag", "owl:Class").schema(OWL_CLASS).load(path).filter("`_rdf:about` is not null and `owl:deprecated` is null")
    base = raw.select(F.col("`_rdf:about`").alias("native_id"), F.coalesce(F.lower(clean_label(F.get("`rdfs:label`", 0))), F.lit("")).alias("name"), F.col("`rdfs:subClassOf`").alias("up"), F.col("`owl:equivalentClass`").alias("eq"), F.col("`oboInOwl:hasDbXref`").alias("db"))
    one = F.when(F.col("name") != "", F.array("name")).otherwise(F.array().cast(NO_STRINGS))
    nodes = base.select("native_id", "name", one.alias("synonyms"), F.transform(one, lambda _: F.lit("label")).alias("synonym_types"), F.lit("{}").alias("raw_attrs"))
    edges = base.select(F.col("native_id").alias("head_native_id"), F.explode("up").alias("u")).select("head_native_id", F.col("u.`_rdf:resource`").alias("tail_native_id"), F.lit("is_a").alias("edge_type"), F.lit("{}").alias("raw_attrs")).filter("tail_native_id is not null")
    described = "array<struct<`_rdf:about`:string>>"
    about = lambda e: F.concat(F.coalesce(e["rdf:Description"], F.array().cast(described)), F.coalesce(e["owl:Class"]["owl:intersectionOf"]["rdf:Description"], F.array().cast(described)))
    chem = base.select("native_id", F.explode(F.flatten(F.transform("eq", about))).alias("d")).select("native_id", F.lit("chebi").alias("target_source"), F.col("d.`_rdf:about`").alias("target_id")).filter(F.col("target_id").contains("CHEBI_"))
    food = base.select("native_id", F.explode("db").alias("d")).filter(F.col("d").startswith("USDA_fdc_id")).select("native_id", F.lit("fdc_nutrient").alias("target_source"), F.substring_index("d", "USDA_fdc_id:", -1).alias("target_id"))
    return _nodes(nodes, "cdno", "class"), _edges(edges, "cdno"), _xrefs(chem.unionByName(food), "cdno")


def ctd(spark: SparkSession, folder: str) -> Frames:
    """Diseases and chemical-disease associations; comment lines hold the header, lists are separated by pipes."""
    csv = spark.read.option("comment", "#").option("escape", '"')
    dis = csv.schema("DiseaseName string, DiseaseID string, AltDiseaseIDs string, Definition string, ParentIDs string, TreeNumbers string, ParentTreeNumbers string, Synonyms string, SlimMappings string").csv(f"{folder}/CTD_diseases.csv").filter("DiseaseID is not null")
    assoc = csv.schema("ChemicalName string, ChemicalID string, CasRN string, DiseaseName string, DiseaseID string, DirectEvidence string, InferenceGeneSymbol string, InferenceScore string, OmimIDs string, PubMedIDs string").csv(f"{folder}/CTD_chemicals_diseases.csv").filter("ChemicalID is not null")
    syn = F.transform(pipe_list(F.col("Synonyms")), lambda s: F.lower(s))
    nodes = dis.select(F.col("DiseaseID").alias("native_id"), F.coalesce(F.lower(F.trim("DiseaseName")), F.lit("")).alias("name"), syn.alias("synonyms"), F.transform(syn, lambda _: F.lit("synonym")).alias("synonym_types"), F.lit("{}").alias("raw_attrs"))
    parents = dis.select(F.col("DiseaseID").alias("head_native_id"), F.explode(pipe_list(F.col("ParentIDs"))).alias("tail_native_id"), F.lit("is_a").alias("edge_type"), F.lit("{}").alias("raw_attrs")).filter("tail_native_id <> ''")
    links = assoc.select(F.col("ChemicalID").alias("head_native_id"), F.col("DiseaseID").alias("tail_native_id"), F.lit("chemical_disease_association").alias("edge_type"), attrs_json(direct_evidence=F.coalesce("DirectEvidence", F.lit("")), PubMedIDs=pipe_list(F.col("PubMedIDs"))).alias("raw_attrs"))
    alt = dis.select(F.col("DiseaseID").alias("native_id"), F.explode(pipe_list(F.col("AltDiseaseIDs"))).alias("a")).filter(F.col("a").contains(":"))
    xrefs = alt.select("native_id", F.lower(F.substring_index("a", ":", 1)).alias("target_source"), F.regexp_replace("a", "^[^:]*:", "").alias("target_id"))
    return _nodes(nodes, "ctd", "disease"), _edges(parents.unionByName(links), "ctd"), _xrefs(xrefs, "ctd")


def newest_release(paths: list[str]) -> str:
    """The last release folder by name."""
    return max(paths)


def fdc(spark: SparkSession, folder: str) -> Frames:
    """Foundation foods with their nutrients; ids are prefixed ``food:`` and ``nutrient:``; a missing amount is 0."""
    csv = spark.read.option("header", True).option("escape", '"').option("enforceSchema", False)
    table = lambda name, schema: csv.csv(f"{folder}/{name}.csv").select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", ")))
    ids = table("foundation_food", "fdc_id bigint").distinct()
    foods = table("food", "fdc_id bigint, description string").join(ids, "fdc_id", "left_semi").select(F.concat(F.lit("food:"), "fdc_id").alias("native_id"), F.lower(F.trim("description")).alias("name"))
    nutrients = table("nutrient", "id bigint, name string, unit_name string").select(F.concat(F.lit("nutrient:"), "id").alias("native_id"), F.lower(F.trim("name")).alias("name"), attrs_json(unit_name=F.col("unit_name")).alias("raw_attrs"))
    own = lambda df: df.withColumns({"synonyms": F.array("name"), "synonym_types": F.array(F.lit("label"))})
    nodes = _nodes(own(foods).withColumn("raw_attrs", F.lit("{}")), "fdc", "food").unionByName(_nodes(own(nutrients), "fdc", "nutrient"))
    contents = table("food_nutrient", "fdc_id bigint, nutrient_id bigint, amount double").join(ids, "fdc_id", "left_semi")
    edges = contents.select(F.concat(F.lit("food:"), "fdc_id").alias("head_native_id"), F.concat(F.lit("nutrient:"), "nutrient_id").alias("tail_native_id"), F.lit("contains").alias("edge_type"), attrs_json(amount=F.coalesce("amount", F.lit(0.0))).alias("raw_attrs"))
    attrs = table("food_attribute", "fdc_id bigint, name string, value string").filter("name = 'FoodOn Ontology ID for FDC Item'").join(ids, "fdc_id", "left_semi")
    xrefs = attrs.select(F.concat(F.lit("food:"), "fdc_id").alias("native_id"), F.lit("foodon").alias("target_source"), F.col("value").alias("target_id"))
    return nodes, _edges(edges, "fdc"), _xrefs(xrefs, "fdc")


def dmd(spark: SparkSession, folder: str) -> Frames:
    """Milk molecules, their ids (JSON and set notation) and concentrations in mg/100g."""
    csv = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    mol = csv.csv(f"{folder}/molecules.csv")
    has = lambda c: F.col(f"`{c}`") if c in mol.columns else F.lit(None).cast("string")
    name, formula = F.coalesce(has("Molecule Name"), F.lit("")), F.coalesce(has("Chemical Composition"), F.lit(""))
    names = F.filter(F.array(F.struct(name.alias("n"), F.lit("name").alias("t")), F.struct(formula.alias("n"), F.lit("synonym").alias("t"))), lambda x: x["n"] != "")
    classes = set_field(has("Molecule Classification"))
    nodes = mol.select(has("DMD ID").alias("native_id"), name.alias("name"), names.alias("s"), attrs_json(molecule_classification=classes, omic_lab=set_field(has("Omic Lab")), molecular_weight=has("Molecular Weight").try_cast("double"), molecular_weight_unit=has("Molecular Weight Unit")).alias("raw_attrs")).select("*", F.col("s.n").alias("synonyms"), F.col("s.t").alias("synonym_types"))
    external = mol.select(has("DMD ID").alias("native_id"), F.explode(F.from_json(has("External Database IDs"), "map<string,array<string>>")).alias("k", "v")).select("native_id", F.try_element_at(_map(DMD_KEYS), F.col("k")).alias("target_source"), F.explode("v").alias("target_id")).filter("target_source is not null")
    kegg = mol.select(has("DMD ID").alias("native_id"), F.lit("kegg").alias("target_source"), F.explode(set_field(has("KEGG IDs"))).alias("target_id"))
    conc = csv.csv(f"{folder}/concentrations.csv").filter("`Concentration Value Alt` is not null")
    est = csv.csv(f"{folder}/estimated.csv").select(F.col("DMD Concentration ID").alias("__id"), F.col("Estimated Concentration Value").try_cast("double").alias("__est"))
    glycans = mol.filter(F.exists(classes, lambda c: F.lower(c) == "glycan")).select(has("DMD ID").alias("__glycan"))
    joined = conc.join(est, conc["DMD ID"] == est["__id"], "left").join(glycans, conc["DMD Molecule ID"] == glycans["__glycan"], "left")
    raw, unit = F.col("Concentration Value Alt").try_cast("double"), F.col("Concentration Unit Alt")
    value = concentration.milk_concentration(raw, unit, F.col("__est"), F.col("__glycan").isNotNull())
    edges = joined.select(F.lit("milk").alias("head_native_id"), F.col("DMD Molecule ID").alias("tail_native_id"), F.lit("contains").alias("edge_type"), attrs_json(conc_value=value, conc_unit=F.when(value.isNotNull(), "mg/100g"), conc_value_raw=raw, conc_unit_raw=unit, dmd_concentration_id=F.col("DMD ID")).alias("raw_attrs"))
    return _nodes(nodes, "dmd", "molecule"), _edges(edges, "dmd"), _xrefs(external.unionByName(kegg), "dmd")


def flavor_rows(spark: SparkSession, flavordb: str, odor: str, taste: str) -> DataFrame:
    """``pubchem_id, flavor, origin, url``: descriptors of both databases; those of the second only for compounds the first lacks."""
    fields = ", ".join(f"{f}:string" for f in FLAVOR_FIELDS)
    raw = spark.read.option("wholetext", True).text(flavordb).select(F.explode(F.from_json("value", f"map<string,struct<{fields},bitter:boolean>>")).alias("id", "c"))
    parts = F.flatten(F.array(*(F.split(F.lower(F.coalesce(f"c.{f}", F.lit(""))), "@") for f in FLAVOR_FIELDS)))
    every = F.concat(parts, F.when(F.coalesce("c.bitter", F.lit(False)), F.array(F.lit("bitter"))).otherwise(F.array().cast(NO_STRINGS)))
    known = raw.select(F.col("id").cast("bigint").alias("pubchem_id"), F.explode(F.array_distinct(F.filter(every, lambda x: x != ""))).alias("flavor"), F.lit("flavordb").alias("origin"), F.concat(F.lit("https://cosylab.iiitd.edu.in/flavordb/molecules_json?id="), "id").alias("url"))
    schema = "Annotations struct<Annotation:array<struct<URL:string,LinkedRecords:struct<CID:array<bigint>>,Data:array<struct<Value:struct<StringWithMarkup:array<struct<String:string>>>>>>>>"
    notes = spark.read.schema(schema).option("multiLine", True).json([odor, taste]).select(F.explode("Annotations.Annotation").alias("a"))
    other = notes.select(F.explode("a.LinkedRecords.CID").alias("pubchem_id"), F.col("a.URL").alias("url"), F.explode("a.Data").alias("d")).select("pubchem_id", F.get("d.Value.StringWithMarkup", 0)["String"].alias("flavor"), F.lit("hsdb").alias("origin"), "url")
    return known.unionByName(other.join(known.select("pubchem_id").distinct(), "pubchem_id", "left_anti").select(*known.columns))


def flavors(rows: DataFrame) -> Frames:
    """One node per compound with its sorted distinct descriptors, one xref to itself."""
    grouped = rows.groupBy(F.col("pubchem_id").cast("string").alias("native_id")).agg(F.array_sort(F.collect_set("flavor")).alias("f"))
    none = F.array().cast(NO_STRINGS)
    nodes = grouped.select("native_id", F.lit("").alias("name"), none.alias("synonyms"), none.alias("synonym_types"), attrs_json(flavors=F.col("f")).alias("raw_attrs"))
    xrefs = grouped.select("native_id", F.lit("pubchem_cid").alias("target_source"), F.col("native_id").alias("target_id"))
    return _nodes(nodes, "flavordb", "flavor_compound"), empty(rows.sparkSession, EDGES), _xrefs(xrefs, "flavordb")


_CONCEPTS = "ConceptList struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"


def mesh(spark: SparkSession, descriptors: str, supplementals: str) -> Frames:
    """Descriptor and supplemental records; ``tree_parent`` edges to ``tree:<number without its last part>``, ``mapped_to`` edges."""
    xml = spark.read.format("xml")
    d = xml.option("rowTag", "DescriptorRecord").schema(f"DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>, {_CONCEPTS}").load(descriptors)
    s = spark.read.format("xml").option("rowTag", "SupplementalRecord").schema(f"SupplementalRecordUI string, SupplementalRecordName struct<String:string>, HeadingMappedToList struct<HeadingMappedTo:array<struct<DescriptorReferredTo:struct<DescriptorUI:string>>>>, {_CONCEPTS}").load(supplementals)
    terms = F.coalesce(F.filter(F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: F.lower(t["String"])))), lambda t: t.isNotNull()), F.array().cast(NO_STRINGS))

    def nodes(df: DataFrame, key: str, name: str, kind: str) -> DataFrame:
        out = df.select(F.col(key).alias("native_id"), F.coalesce(F.lower(F.trim(name)), F.lit("")).alias("name"), terms.alias("synonyms"), F.lit("{}").alias("raw_attrs"))
        return _nodes(out.withColumn("synonym_types", _synonyms(F.col("synonyms"))), "mesh", kind)

    tree = d.select(F.col("DescriptorUI").alias("head_native_id"), F.explode("TreeNumberList.TreeNumber").alias("t")).filter(F.col("t").contains("."))
    up = tree.select("head_native_id", F.concat(F.lit("tree:"), F.regexp_replace("t", r"\.[^.]*$", "")).alias("tail_native_id"), F.lit("tree_parent").alias("edge_type"), F.lit("{}").alias("raw_attrs"))
    mapped = s.select(F.col("SupplementalRecordUI").alias("head_native_id"), F.explode("HeadingMappedToList.HeadingMappedTo").alias("h")).select("head_native_id", F.ltrim(F.col("h.DescriptorReferredTo.DescriptorUI"), F.lit("*")).alias("tail_native_id"), F.lit("mapped_to").alias("edge_type"), F.lit("{}").alias("raw_attrs")).filter("tail_native_id <> ''")
    both = nodes(d, "DescriptorUI", "DescriptorName.String", "descriptor").unionByName(nodes(s, "SupplementalRecordUI", "SupplementalRecordName.String", "supplemental"))
    return both, _edges(up.unionByName(mapped), "mesh"), empty(spark, XREFS)


def pubchem(spark: SparkSession, sid_map: str, cid_mesh: str) -> Frames:
    """Two xref families. The large map is filtered by its source column before anything else is read from a row."""
    tsv = spark.read.option("sep", "\t").option("quote", "")
    sid = tsv.schema("sid string, source string, registry_id string, cid bigint").csv(sid_map).filter("source = 'ChEBI' and cid is not null")
    mesh_terms = tsv.schema("cid bigint, mesh_term string, mesh_term_alt string").csv(cid_mesh)
    one = sid.select(F.col("cid").cast("string").alias("native_id"), F.lit("chebi").alias("target_source"), F.col("registry_id").alias("target_id"))
    two = mesh_terms.select(F.col("cid").cast("string").alias("native_id"), F.lit("mesh_term").alias("target_source"), F.col("mesh_term").alias("target_id"))
    return empty(spark, NODES), empty(spark, EDGES), _xrefs(one.unionByName(two), "pubchem")


def write_source(frames: Frames, root: str) -> None:
    """Standard frames below ``root/<table>``, partitioned by source so that one source reads back alone."""
    for table, df in zip(TABLES, frames):
        df.write.mode("append").partitionBy("source_id").parquet(f"{root}/{table}")


def load_sources(spark: SparkSession, root: str, sources: list[str] | None = None) -> dict[str, DataFrame]:
    """The standard tables of all or some sources; partition pruning leaves the others unread."""
    out = {}
    for table, schema in zip(TABLES, (NODES, EDGES, XREFS)):
        df = conform(spark.read.schema(schema).parquet(f"{root}/{table}"), schema)
        out[table] = df if sources is None else df.filter(F.col("source_id").isin(*sources))
    return out


def manifest(frames: dict[str, DataFrame]) -> DataFrame:
    """``source_id, nodes, edges, xrefs``: row counts per source."""
    parts = [df.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(name)) for name, df in frames.items()]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("source_id").agg(*(F.sum(F.when(F.col("t") == t, F.col("n")).otherwise(0)).alias(t) for t in TABLES))


def python_literal_list(c: Column) -> Column:
    """``['a', 'b']`` as an array; anything else as an empty one."""
    return F.coalesce(F.from_json(F.translate(c, "'", '"'), NO_STRINGS), F.array().cast(NO_STRINGS))


def old_release(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entities, triplets) of an earlier release: TSV with list literals; triplets and ontology in one table."""
    tsv = spark.read.option("sep", "\t").option("header", True)
    e = tsv.csv(f"{folder}/entities.tsv").select("entity_id", "entity_type", "common_name", python_literal_list(F.col("synonyms")).alias("synonyms"))
    cols = ["head_id", "relationship_id", "tail_id"]
    t = tsv.csv(f"{folder}/triplets.tsv").select(*cols).unionByName(tsv.csv(f"{folder}/food_ontology.tsv").select(*cols))
    return e, t
