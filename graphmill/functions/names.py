"""Names: standard spelling, labels, identifiers, display forms. Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: forms of Greek letters by their English names
GREEK = {
    "alpha": "α𝛂𝛼𝜶𝝰𝞪Α𝚨𝛢𝜜𝝖𝞐ἀἈἄἌᾄᾌἂἊᾂᾊἆἎᾆᾎᾀᾈἁἉἅἍᾅᾍἃἋᾃᾋἇἏᾇᾏᾁᾉάάΆΆᾴὰᾺᾲᾰᾸᾶᾷᾱᾹᾳᾼ⍺ɑ",
    "beta": "βϐ𝛃𝛽𝜷𝝱𝞫Β𝚩𝛣𝜝𝝗𝞑ᵝᵦßꞵ",
    "gamma": "γℽ𝛄𝛾𝜸𝝲𝞬Γℾ𝚪𝛤𝜞𝝘𝞒ᵞᵧᴦɣ",
    "delta": "δ𝛅𝛿𝜹𝝳𝞭Δ𝚫𝛥𝜟𝝙𝞓ᵟ∆",
    "epsilon": "εϵ𝛆𝛜𝜀𝜖𝜺𝝐𝝴𝞊𝞮𝟄Ε𝚬𝛦𝜠𝝚𝞔ἐἘἔἜἒἚἑἙἕἝἓἛέέΈΈὲῈɛ",
    "zeta": "ζ𝛇𝜁𝜻𝝵𝞯Ζ𝚭𝛧𝜡𝝛𝞕",
    "eta": "η𝛈𝜂𝜼𝝶𝞰Η𝚮𝛨𝜢𝝜𝞖ἠἨἤἬᾔᾜἢἪᾒᾚἦἮᾖᾞᾐᾘἡἩἥἭᾕᾝἣἫᾓᾛἧἯᾗᾟᾑᾙήήΉΉῄὴῊῂῆῇῃῌ",
    "theta": "θϑ𝛉𝛝𝜃𝜗𝜽𝝑𝝷𝞋𝞱𝟅Θϴ𝚯𝚹𝛩𝛳𝜣𝜭𝝝𝝧𝞗𝞡ᶿ",
    "omega": "ω𝛚𝜔𝝎𝞈𝟂ΩΩꭥ𝛀𝛺𝜴𝝮𝞨ὠὨὤὬᾤᾬὢὪᾢᾪὦὮᾦᾮᾠᾨὡὩὥὭᾥᾭὣὫᾣᾫὧὯᾧᾯᾡᾩώώΏΏῴὼῺῲῶῷῳῼꭥ",
    "kappa": "κ",
    "lambda": "λ",
    "iota": "ι",
    "sigma": "∑σ",
    "tao": "τ",
    "mu": "μ",
    "nu": "ν",
    "xi": "ξ",
    "omicron": "ο",
    "pi": "π",
    "rho": "ρ",
    "upsilon": "υ",
    "phi": "φ",
    "chi": "χ",
    "psi": "ψ",
}
# fixed values: punctuation in ASCII: none, dashes, double quotes, single quotes, arrow
PUNCTUATION = {"": "\u00ad\u00a0\u2009", "-": "\u2010\u2212\u2013\u2011\u2014\u2012", '"': "\u201c\u201d\u2033", "'": "\u2018\u2019\u2032\u02b9\u02cb", "->": "\u2192"}


def standardize_name(name: Column) -> Column:
    """Greek letters in words, punctuation in ASCII, trimmed, lower case."""
    # a letter's forms become the first of them, which one replacement then spells out
    folds = [(c, forms[0]) for forms in GREEK.values() for c in forms[1:]]
    single = [(c, to) for to, chars in PUNCTUATION.items() if len(to) == 1 for c in chars]
    out = F.translate(name, "".join(c for c, _ in folds + single), "".join(t for _, t in folds + single))
    out = F.translate(out, PUNCTUATION[""], "")
    out = F.replace(out, F.lit(PUNCTUATION["->"]), F.lit("->"))
    out = reduce(lambda c, word: F.replace(c, F.lit(GREEK[word][0]), F.lit(word)), GREEK, out)
    return F.lower(F.trim(out))


def same_spelling(a: Column, b: Column) -> Column:
    """Equality up to Greek and Latin spelling."""
    return standardize_name(a) == standardize_name(b)


def strip_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"^<(.*)>$", "$1")


def strip_literal(c: Column) -> Column:
    """A literal without its ``@language``, or else without its ``^^type``."""
    return F.when(c.contains("@"), F.substring_index(c, "@", 1)).otherwise(F.substring_index(c, "^^", 1))


def clean_label(c: Column) -> Column:
    """A label without a leading ``PREFIX:`` and a trailing bracketed remark."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^[A-Z]+:\s*", ""), r"\s*\([^()]*\)$", ""))


def chebi_number(url: Column) -> Column:
    return F.expr("try_cast(NULL AS bigint)") if url is None else F.substring_index(url, "CHEBI_", -1).try_cast("bigint")


def after_colon(c: Column) -> Column:
    return F.substring_index(c, ":", -1)


def pmc_number(c: Column) -> Column:
    return F.regexp_replace(c, r"^PMC", "")


def pipe_list(c: Column) -> Column:
    """Parts between pipes; null gives an empty array."""
    return F.coalesce(F.split(c, r"\|"), F.array().cast("array<string>"))


def set_field(c: Column) -> Column:
    """``{a,"b,c"}`` as an array; commas inside quotes stay, empty members go."""
    inner = F.regexp_replace(F.trim(c), r"^\{(.*)\}$", "$1")
    items = F.regexp_extract_all(inner, F.lit(r'((?:[^,"]|"[^"]*")+)'), F.lit(1))
    items = F.transform(items, lambda x: F.trim(F.replace(x, F.lit('"'), F.lit(""))))
    return F.coalesce(F.filter(items, lambda x: x != ""), F.array().cast("array<string>"))


# fixed values: display name and address template of each identifier source
ID_SOURCES = {
    "foodon": ("FoodOn", ""),
    "chebi": ("ChEBI", "https://www.ebi.ac.uk/chebi/searchId.do?chebiId=CHEBI:{}"),
    "fdc": ("FDC", "https://fdc.nal.usda.gov/fdc-app.html#/food-details/{}"),
    "fdc_nutrient": ("FDC Nutrient", ""),
    "cdno": ("CDNO", ""),
    "ctd": ("CTD", "https://ctdbase.org/detail.go?type=disease&acc={}"),
    "dmd": ("DMD", ""),
    "pubchem_compound": ("PubChem", "https://pubchem.ncbi.nlm.nih.gov/compound/{}"),
    "mesh": ("MeSH", "https://meshb.nlm.nih.gov/record/ui?ui={}"),
}


def _lookup(key: Column, k: int) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for s, v in ID_SOURCES.items() for x in (s, v[k]))), key)


def id_display(key: Column) -> Column:
    return F.coalesce(_lookup(key, 0), F.upper(key))


def id_url(key: Column, value: Column) -> Column:
    template = F.coalesce(_lookup(key, 1), F.lit(""))
    return F.when(template != "", F.replace(template, F.lit("{}"), value)).when(F.startswith(value, F.lit("http")), value).otherwise(F.lit(""))


def format_external_ids(ids: Column) -> Column:
    """map key -> struct(display_name, ids array of struct(id, url))."""
    shown = F.transform_values(ids, lambda k, v: F.struct(id_display(k).alias("display_name"), F.transform(v, lambda x: F.struct(x.alias("id"), id_url(k, x).alias("url"))).alias("ids")))
    return F.coalesce(shown, F.create_map().cast("map<string,struct<display_name:string,ids:array<struct<id:string,url:string>>>>"))


# fixed values: how good each synonym type is as a common name
NAME_PRIORITY = {"name": 10, "label": 9, "label_alt": 7, "exact": 6, "iupac": 5, "synonym": 4, "narrow": 3, "broad": 2, "taxon": 1}


def pick_common_name(names: Column, types: Column) -> Column:
    """The name of the best type, the first among equals; ``""`` without names. A star rating adds to all alike and changes nothing."""
    rank = F.create_map(*(F.lit(x) for kv in NAME_PRIORITY.items() for x in kv))
    scored = F.transform(F.arrays_zip(names.alias("n"), types.alias("t")), lambda x, i: F.struct(F.coalesce(F.try_element_at(rank, x["t"]), F.lit(0)).alias("s"), (-i).alias("i"), x["n"].alias("n")))
    return F.coalesce(F.array_max(scored)["n"], F.lit(""))


def search_tokens(kind: Column, name: Column, scientific: Column, synonyms: Column, ids: Column) -> Column:
    """Exact tokens of an entity: type, names, synonyms of at most 200 characters, ids (of addresses the last part)."""
    values = F.transform(F.flatten(F.map_values(ids)), lambda x: F.when(x.contains("/"), F.substring_index(x, "/", -1)).otherwise(x))
    short = F.filter(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: F.length(s) <= 200)
    every = F.concat(F.array(kind, name, scientific), short, F.coalesce(values, F.array().cast("array<string>")))
    return F.array_distinct(F.transform(F.filter(every, lambda x: F.coalesce(x, F.lit("")) != ""), lambda x: F.lower(x)))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded with two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams."""
    x, y = trigrams(a), trigrams(b)
    either = F.size(F.array_union(x, y))
    return F.when(either > 0, F.size(F.array_intersect(x, y)) / either).otherwise(F.lit(0.0))


def display_name(source: Column, raw: Column, entity: Column, curated: tuple[str, ...] = ("fdc", "dmd")) -> Column:
    """The entity's name for curated sources, the raw name for others unless it is empty."""
    return F.when(source.isin(*curated) | (F.coalesce(raw, F.lit("")) == ""), entity).otherwise(raw)


def raw_concentration(value: Column, unit: Column) -> Column:
    return F.nullif(F.trim(F.concat_ws(" ", value, unit)), F.lit(""))


def publication(pmid: Column, pmcid: Column) -> Column:
    """struct(pmid, pmcid, url) of a publication; null where neither id is there."""
    url = F.when(pmcid.isNotNull(), F.concat(F.lit("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC"), pmcid)).otherwise(F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid))
    return F.when(pmid.isNotNull() | pmcid.isNotNull(), F.struct(pmid.alias("pmid"), pmcid.alias("pmcid"), url.alias("url")))


def score_label(score: Column) -> Column:
    return F.when(score < 0.33, "implausible").when(score < 0.67, "suspicious").when(score.isNotNull(), "plausible")


def content_id(prefix: str, *parts: Column) -> Column:
    """Prefix and 12 hex digits of the SHA-256 of the parts joined by colons; null parts count as empty."""
    joined = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 12))


def signal_id(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def concise_number(value: Column) -> Column:
    """Two decimals, or scientific below 0.01; an exact zero is ``0``."""
    return F.when(value == 0, "0").when(F.abs(value) < 0.01, F.format_string("%.2e", value)).otherwise(F.format_string("%.2f", value))


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("--"))


def plural(word: Column) -> Column:
    """A regular English plural."""
    return (
        F.when(word.rlike("[^aeiou]y$"), F.regexp_replace(word, "y$", "ies"))
        .when(word.rlike("(s|x|z|ch|sh)$"), F.concat(word, F.lit("es")))
        .otherwise(F.concat(word, F.lit("s")))
    )


def display_synonyms(names: Column) -> Column:
    """The names before the first one that is the plural or singular of its predecessor, that one left out."""
    at = F.array_position(F.transform(names, lambda x, i: F.when(i == 0, F.lit(False)).otherwise((plural(F.lower(F.get(names, i - 1))) == F.lower(x)) | (plural(F.lower(x)) == F.lower(F.get(names, i - 1))))), True)
    return F.when(at > 0, F.slice(names, F.lit(1), (at - 1).cast("int"))).otherwise(names)
