"""Column functions on text: stripping, titles, separators, prompts, dates, decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The heading patterns, in the order in which they are tried. (?Ud) makes \s, \d and . mean what
# they mean in Python.
TITLE_PATTERNS = (
    r"^#{1,6}\s+.+$",
    r"^\d+\.[\d\.]*\s+[A-ZÁÉÍÓÚÑ].*$",
    r"^[IVXLCDM]+\.\s+.+$",
    r"^[A-Z][A-Z\s]{3,}$",
    r"^(?:Capítulo|Sección|Artículo|Anexo)\s+\d*.*$",
    r"^(?:Chapter|Section|Article|Annex)\s+\d*.*$",
)

# The separators that follow the titles, strongest first.
BASE_SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ")


def strip(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def detect_titles(text: Column) -> Column:
    """The distinct separators ``\\n<title>\\n`` of lines that look like headings, in order of appearance."""
    looks = F.lit(False)
    lines = F.transform(F.split(text, "\n", -1), strip)

    def is_title(line: Column) -> Column:
        found = looks
        for pattern in TITLE_PATTERNS:
            found = found | line.rlike("(?Ud)" + pattern)
        return found & (F.length(line) > 3)

    return F.array_distinct(F.transform(F.filter(lines, is_title), lambda line: F.concat(F.lit("\n"), line, F.lit("\n"))))


def build_separators(titles: Column) -> Column:
    """Titles, longest first and otherwise as they came, then the fixed separators."""
    keyed = F.transform(titles, lambda t, k: F.struct((-F.length(t)).alias("n"), k.alias("k"), t.alias("t")))
    return F.concat(F.transform(F.array_sort(keyed), lambda x: x["t"]), F.array(*map(F.lit, BASE_SEPARATORS)))


def chunk_config(num_pages: Column) -> Column:
    """chunk_size, chunk_overlap and use_ocr by number of pages."""

    def tier(size: int, overlap: int, ocr: bool) -> Column:
        return F.struct(F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"), F.lit(ocr).alias("use_ocr"))

    return F.when(num_pages <= 10, tier(800, 150, False)).when(num_pages <= 50, tier(1200, 150, False)).when(num_pages <= 150, tier(1800, 100, True)).otherwise(tier(2500, 80, True))


def render_prompt(template: Column, context: Column, query: Column) -> Column:
    """template with {context} and {query} put in, in one pass: braces in what is put in stay as they are.

    Null where the template is null; a null context or query counts as empty.
    """
    context, query = F.coalesce(context, F.lit("")), F.coalesce(query, F.lit(""))
    parts = F.transform(F.split(template, r"[{]query[}]", -1), lambda part: F.replace(part, F.lit("{context}"), context))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(parts, 1), lambda text, part: F.concat(text, query, part))


def is_json(text: Column) -> Column:
    """Is the whole text one JSON value? Spark's readers stop after the first value, so it is read once as the only
    item of an array and once as the only member of an object: what follows a value breaks one of them."""
    array, item = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"v":'), text, F.lit("}"))
    return F.coalesce(F.try_parse_json(array).isNotNull() & (F.json_array_length(array) == 1) & F.try_parse_json(item).isNotNull(), F.lit(False))


def strip_reasoning(text: Column) -> Column:
    """text without <reasoning> blocks, stripped; null gives an empty text, an unclosed tag stays."""
    return F.coalesce(strip(F.regexp_replace(text, r"(?s)<reasoning>.*?</reasoning>", "")), F.lit(""))


def format_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_decimal(text: Column) -> Column:
    """Decimal from text with points for thousands and a comma for the fraction; bad text gives null."""
    return F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("decimal(38,10)")


def tenant_key(tenant_id: Column) -> Column:
    """A request's tenant as the chunk table names it."""
    return F.concat(F.lit("tenant_"), tenant_id)


def session_prompt(tenant_id: Column, agent_id: Column, query: Column) -> Column:
    """The long form of a request to the agent."""
    return F.concat(F.lit("Contexto de la sesión:\n- tenant_id: "), tenant_id, F.lit("\n- agent_id: "), F.coalesce(agent_id, F.lit("")), F.lit("\n\nSolicitud del usuario: "), query)


def compact_session_prompt(tenant_id: Column, agent_id: Column, query: Column) -> Column:
    """The short form; a missing agent is left out."""
    agent = F.when(F.coalesce(agent_id, F.lit("")) != "", F.concat(F.lit(", agent_id="), agent_id)).otherwise("")
    return F.concat(F.lit("Contexto: tenant_id="), tenant_id, agent, F.lit("\n\nPregunta: "), query)
