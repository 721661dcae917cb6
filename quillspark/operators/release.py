"""What may go out: the parts of a public guide, the files of a release, and the state that a preview must be in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import checks as C
from quillspark.operators.rules import Each, Mirror, Once, Row, Total, compiled, counted, marked, required

# Names of files, markers, phrases, states and limits of the release rules.
FORBIDDEN_FILES = ("book.pdf", "book_ocr.pdf", "book.md", "book_pages.jsonl", "book_pages.cleaned.jsonl", "book_chunks.jsonl")
ALLOWED_FILES = (
    "project.json", "route_segments.json", "route.geojson", "route_places.geojson", "route.gpx", "route_walkable_blocks.json", "field_guide.md", "review_index.md",
    "book_overview.json", "segment_reading_cards.json", "place_index.json", "book_themes.json", "chapter_reading_cards.json", "key_concepts.json", "quote_index.json", "reading_questions.json",
)
IGNORED = (
    "projects/*/private/", "projects/*/review_pack/pages/", "source/", "data/ocr/", "data/book.md", "data/book_pages.jsonl", "data/book_pages.cleaned.jsonl", "data/book_chunks.jsonl",
    "data/review_pack/pages/", "web/dist/", "web/node_modules/", "__pycache__/", "*.pyc", ".venv/", "node_modules/", ".DS_Store", "Thumbs.db", ".vscode/",
)
HIGH_RISK_COPY = ("完整可导航路线", "确定可走", "精确轨迹", "无需复核", "官方路线")
INTERNAL_MARKERS = ("OAI-MEM-CITATION", "MEMORY.md", "rollout_ids")
TEXT_SUFFIXES = (".md", ".txt", ".json", ".jsonl", ".geojson", ".gpx", ".tsx", ".ts", ".js", ".jsx", ".html", ".css", ".yml", ".yaml")
SCANNED = ("README.md", "docs/", "scripts/", "web/src/", "web/public/", "projects/", "data/", ".github/")
UNSCANNED = ("web/node_modules/", "web/dist/", "projects/dadou-shangdu/private/", "data/ocr/", "data/review_pack/pages/", "scripts/check_public_release.py")
IMAGES, LARGE_IMAGE, QUOTE_MARKS, LONG_EXCERPT = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff"), 500_000, ("摘", "quote", "引文", "原文"), 180
GUIDE_MARKERS = ("private/", "private\\", "private/source", "/mnt/", "D:/", "D:\\", "book.epub", "book.md", "book_sections.jsonl", "book_chunks.jsonl", "full_text", "raw_text", "chapter_text")
SOURCE_MARKERS = ("private/", "private\\", "/mnt/", "D:/", "D:\\", "book.epub", "book.md", "book_sections", "book_chunks")
BANNED_STATUSES = ("reviewed", "final", "publish-ready", "publish_ready", "reviewed-draft")
#: What no source line of the web pages may hold, by label (the paths that must go through its helpers).
WEB_PATHS = {
    "fetch('/projects or fetch(\"/projects": r"fetch\(\s*['\"]/projects", "fetch(`/projects": r"fetch\(\s*`/projects", "fetch('/data or fetch(\"/data": r"fetch\(\s*['\"]/data", "fetch(`/data": r"fetch\(\s*`/data",
    'href="/projects': r"href\s*=\s*['\"]/projects", "href={'/projects": r"href\s*=\s*\{\s*['\"]/projects", "href={`/projects": r"href\s*=\s*\{\s*`/projects",
    'href="/data': r"href\s*=\s*['\"]/data", "href={'/data": r"href\s*=\s*\{\s*['\"]/data", "href={`/data": r"href\s*=\s*\{\s*`/data",
}
PREVIEW, PENDING, DRAFT, NO_QUOTE, CARD_STATUS = "public-preview", "manual-review-pending", "draft", "structural_no_quote", "auto_structural_draft"


def _index(name: str, rest: str = "") -> Column:
    return F.concat(F.lit(name + "["), (F.col("place") - 1).cast("string"), F.lit("]" + rest))


def guide_public(documents: DataFrame, cards: DataFrame, concepts: DataFrame, quotes: DataFrame, questions: DataFrame, mirror: DataFrame, sections: tuple[str, ...], version: str, status: str, count: int = 25) -> DataFrame:
    """C3. documents, mirror: name, schema_version, status, book (struct of title, author, language, source_type), body; cards: place
    (from 1), section_id, review_status and the fields; concepts, quotes, questions: place and their fields."""
    name = F.col("name")
    book = [Row("C3.book", "error", F.concat(name, F.lit(f".book.{f}")), f"missing book field: {f}", F.col("book").isNotNull() & (F.coalesce(F.col(f"book.{f}"), F.lit("")) == "")) for f in ("title", "author", "language", "source_type")]
    common = [
        Row("C3.version", "error", name, f"schema_version must be {version}", ~F.col("schema_version").eqNullSafe(version)), Row("C3.status", "error", name, f"status must be {status}", ~F.col("status").eqNullSafe(status)),
        Row("C3.book", "error", F.concat(name, F.lit(".book")), "book must be there", F.col("book").isNull()), *book, marked("C3.marker", name, "forbidden markers found", F.col("body"), GUIDE_MARKERS),
        Mirror("C3.mirror", name, "public and mirror differ", ("name",), ("schema_version", "status", "book", "body"), mirror),
    ]
    want = F.when(F.col("place") > 0, F.try_element_at(F.array(*map(F.lit, sections)), F.col("place").cast("int")))
    card = [
        counted("C3.cards", "chapters", count), Row("C3.section", "error", _index("chapters", ".section_id"), "section out of order", ~F.col("section_id").eqNullSafe(want)), *required("C3.field", _index("chapters"), ["chapter_id", "letter_id", "title", "summary"]),
        Row("C3.review", "warning", _index("chapters", ".review_status"), "unexpected review_status", ~F.col("review_status").eqNullSafe(CARD_STATUS)),
    ]
    concept = [
        Total("C3.concepts", "error", "concepts", "must not be empty", {"n": F.count(F.lit(1))}, lambda v: v["n"] == 0), *required("C3.field", _index("concepts"), ["concept_id", "label", "description", "review_status"]),
        Row("C3.letters", "error", _index("concepts", ".related_letters"), "must be a non-empty list", F.coalesce(F.size("related_letters"), F.lit(0)) < 1),
    ]
    text = F.coalesce("quote", F.lit(""))
    quote = [
        counted("C3.quotes", "quotes", count), Row("C3.mode", "error", _index("quotes", ".quote_mode"), f"must be {NO_QUOTE}", ~F.col("quote_mode").eqNullSafe(NO_QUOTE)),
        Row("C3.quote", "error", _index("quotes", ".quote"), "must be empty", text != ""), Row("C3.quote", "error", _index("quotes", ".quote"), F.concat(F.lit("quote too long: "), F.length(text).cast("string")), F.length(text) > 80),
    ]
    asked = F.coalesce("question", F.lit(""))
    question = [
        Total("C3.questions", "error", "questions", lambda v: F.concat(F.lit(f"expected at least {count + 1}, got "), v["n"].cast("string")), {"n": F.count(F.lit(1))}, lambda v: v["n"] < count + 1),
        *required("C3.field", _index("questions"), ["question_id", "scope", "basis", "review_status"]), Row("C3.question", "error", _index("questions", ".question"), "must not be empty", asked == ""),
        Row("C3.question", "warning", _index("questions", ".question"), F.concat(F.lit("question is long: "), F.length(asked).cast("string")), F.length(asked) > 180),
    ]
    return C.union([compiled(documents, common), compiled(cards, card), compiled(concepts, concept), compiled(quotes, quote), compiled(questions, question)])


def _under(path: Column, folders: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, folders)), lambda f: F.startswith(path, f))


def release_boundary(files: DataFrame, ignore: DataFrame, projects: DataFrame, quotes: DataFrame, longest: int = 120) -> DataFrame:
    """G22. files: path (from the top, with /), bytes, text (null where it is no text); ignore: line; projects: slug, public_files
    (array, null where it is no list); quotes: path, segment_id, quote. What the version control tracks is not asked."""
    path, low = F.col("path"), F.lower(F.col("path"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    suffix = F.regexp_extract(name, r"\.[^.]*$", 0)
    public = F.startswith(path, F.lit("web/public/")) | path.rlike("^projects/[^/]+/public/")
    project = path.rlike("^web/public/projects/[^/]+/.")
    image = suffix.isin(*IMAGES) & ((F.col("bytes") >= LARGE_IMAGE) | name.rlike(r"^page_\d+\.(png|jpg|jpeg|webp)$"))
    excerpts = F.exists(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.exists(F.array(*map(F.lit, QUOTE_MARKS)), lambda m: F.contains(x, m)) & (F.length(T.strip(x)) > LONG_EXCERPT))
    scanned = _under(path, SCANNED) & ~_under(path, UNSCANNED) & suffix.isin(*TEXT_SUFFIXES)
    holds = lambda m: F.contains(F.coalesce("text", F.lit("")), F.lit(m))
    file_rules = [
        Row("G22.private", "error", path, "private file in a public folder", public & name.isin(*FORBIDDEN_FILES)), Row("G22.scan", "error", path, "rendered review page in a public folder", public & F.contains(low, F.lit("/review_pack/pages/")) & (suffix == ".png")),
        Row("G22.image", "error", path, "large or page-numbered image in a public folder", public & image), Row("G22.unexpected", "error", path, "unexpected file in a public project", project & ~F.element_at(F.split("path", "/"), -1).isin(*ALLOWED_FILES)),
        Row("G22.excerpt", "warning", path, "may contain long source excerpts", project & (name == "review_index.md") & excerpts),
        *[Row("G22.marker", "error", path, f"internal marker: {m}", scanned & holds(m)) for m in INTERNAL_MARKERS],
        *[Row("G22.copy", "error", path, f"high-risk copy: {m}", scanned & F.startswith(path, F.lit("web/src/")) & holds(m)) for m in HIGH_RISK_COPY],
    ]
    line = F.replace(T.strip(F.coalesce("line", F.lit(""))), F.lit("\\"), F.lit("/"))
    missing = lambda p: Total("G22.ignore", "error", ".gitignore", f"missing ignore pattern: {p}", {"n": F.count_if(line == p)}, lambda v: v["n"] == 0)
    entry = F.lit("web/public/projects/index.json")
    slug = F.coalesce("slug", F.lit(""))
    here = F.concat(F.lit("web/public/projects/"), F.col("slug"))
    named = projects.where(slug != "").withColumn("_at", here)
    known = files.select("path").distinct()
    asked = named.select(F.concat("_at", F.lit("/project.json")).alias("path"), F.lit("missing project.json").alias("m")).unionByName(named.select(F.explode("public_files").alias("_f"), "_at").where("_f IS NOT NULL").select(F.concat("_at", F.lit("/"), "_f").alias("path"), F.lit("public file is missing").alias("m")))
    lost = asked.distinct().join(known, "path", "left_anti")
    gone = [C.rows_where(lost, "G22.missing", "error", F.col("path"), m, F.col("m") == m) for m in ("missing project.json", "public file is missing")]
    project_rules = [
        Row("G22.project", "error", entry, "invalid project entry", slug == ""), Row("G22.list", "error", F.concat(here, F.lit("/project.json")), "public_files must be a list", (slug != "") & F.col("public_files").isNull()),
        Each(F.col("public_files"), lambda f, i: [Row("G22.list", "error", F.concat(here, F.lit("/project.json")), "public_files holds an entry without a name", (slug != "") & f.isNull())]),
    ]
    long = Row("G22.quote", "warning", path, F.concat(F.coalesce("segment_id", F.lit("unknown")), F.lit(" quote is "), F.length("quote").cast("string"), F.lit(f" chars, over {longest}")), F.length("quote") > longest)
    return C.union([compiled(files, file_rules), compiled(ignore, [missing(p) for p in IGNORED]), compiled(projects, project_rules), compiled(quotes, [long]), *gone])


def preview_state(public: DataFrame, web: DataFrame, tasks: DataFrame, count: int = 95) -> DataFrame:
    """G39. public, web: name, status, release_phase, review_status, body; tasks: kind, task_id, manual_result. Both sides hold the same, are drafts in
    preview with their review pending, name no source, and no task of either kind has a result yet."""
    both = public.withColumn("side", F.lit("public")).unionByName(web.withColumn("side", F.lit("web")))
    at = F.concat_ws(".", "name", "side")
    status = F.lower(F.coalesce("status", F.lit("")))
    state = [
        Row("G39.status", "error", F.concat(at, F.lit(".status")), f"expected {DRAFT}", status != DRAFT), Row("G39.status", "error", F.concat(at, F.lit(".status")), F.concat(F.lit("promoted status: "), status), status.isin(*BANNED_STATUSES)),
        Row("G39.phase", "error", F.concat(at, F.lit(".release_phase")), f"expected {PREVIEW}", ~F.col("release_phase").eqNullSafe(PREVIEW)), Row("G39.review", "error", F.concat(at, F.lit(".review_status")), f"expected {PENDING}", ~F.col("review_status").eqNullSafe(PENDING)),
        marked("G39.marker", at, "forbidden source markers found", F.col("body"), SOURCE_MARKERS), Once("G39.once", F.concat_ws(".", "name", "side"), "stands more than once", ("name", "side")),
    ]
    mirror = Mirror("G39.mirror", F.col("name"), "public and mirror differ", ("name",), ("status", "release_phase", "review_status", "body"), web)
    blank = T.strip(F.coalesce("manual_result", F.lit(""))) == ""
    of = lambda kind: Total("G39.blank", "error", kind, lambda v: F.concat(F.lit(f"expected {count} blank results, got rows="), v["n"].cast("string"), F.lit(" blank="), v["b"].cast("string")), {"n": F.count_if(F.col("kind") == kind), "b": F.count_if((F.col("kind") == kind) & blank)}, lambda v: (v["n"] != count) | (v["b"] != count))
    return C.union([compiled(both, state), compiled(public, [mirror]), compiled(tasks, [of("tasks"), of("template")])])
