"""Problem 1: titles that are unfilled templates, filler, empty markers, or error, access and script notices."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import spread, written

#: Words below the level of the number of words that the prefix tree branches by.
DEPTH = 3
#: Share of its parent's titles that a word needs to be a branch of its own.
BRANCH = 0.01
#: Sites that a wording needs to be learned as a message.
SITES = 3
#: Mean log-odds of a template's words from which it is worded like the known messages.
WORDING = 3.0
WILD = "<*>"
SITE = "<site>"
NUMBER = "<num>"

# --- Unresolved slots -------------------------------------------------------------------------------------------
_NAME = r"[A-Za-z][\w.\-]*"
SLOT = re.compile(
    "|".join(
        (
            r"\{\{\s*[#/&>]?\s*" + _NAME + r"[^{}]*\}\}",
            r"\{%-?\s*" + _NAME + r"[^{}]*%\}",
            r"[$#]\{\s*" + _NAME + r"[^{}]*\}",
            r"\{!\s*" + _NAME + r"[^{}]*\}",
            r"\{" + _NAME + r"\}",
            r"<%(?:(?!<%).)+?%>",
            r"<!--\s*" + _NAME + r"\s*-->",
            r"<\?(?:php|=)(?:(?!<\?).)*?\?>",
            r"\[\[\s*" + _NAME + r"\s*\]\]",
            r"\[[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)*\]",
            r"\[[a-z]+[_.][a-z_.]+\]",
            r"%%\s*" + _NAME + r"\s*%%",
            r"(?<![\w%])%[A-Z][A-Z0-9_]+%(?!\w)",
            r"@@\s*" + _NAME + r"\s*@@",
            r"(?<!\w)__[A-Z][A-Z0-9_]*?__(?!\w)",
            r"(?<![\w$])\$[A-Z][A-Z0-9_]+\$(?!\w)",
        )
    )
)
_SLOT_MARK = re.compile(r"[{\[<%@$_]")
#: Words by which a title that shows a slot is about slots.
_ABOUT_SLOTS = re.compile(r"\b(?:templates?|placeholders?|variables?|syntax|merge tags?|snippets?|template literals?|tutorials? on)\b", re.I)


def has_slot(title: str) -> bool:
    """Whether a title holds an unresolved slot, unless its own words are about slots."""
    if not _SLOT_MARK.search(title) or not SLOT.search(title):
        return False
    return not _ABOUT_SLOTS.search(SLOT.sub(" ", title))


# --- Messages ---------------------------------------------------------------------------------------------------
#: Empty-value markers.
EMPTY = r"undefined|null|nil|none|nan|n/?a|void|\(null\)|\(none\)|\(empty\)|\(undefined\)|\[object object\]|#ref!|#n/a|#value!|#name\?|#div/0!|#null!|#num!|-+|\.+|_+|\?+"

#: What servers, gates and hosts say instead of content.
NOTICES = (
    r"(?:http )?(?:error|fehler|erreur|ошибка|błąd|erro)[ :#-]*[1-5]\d\d(?: .{0,40})?",
    r"(?:http[ /]?(?:1\.[01] ?)?)?[45]\d\d(?: ?[-:] ?| )(?:error|bad request|unauthori[sz]ed|payment required|forbidden|(?:page |file )?not found|method not allowed|not acceptable|request time-?out|conflict|gone|too many requests|unavailable for legal reasons|internal (?:server )?error|not implemented|bad gateway|(?:service )?(?:temporarily )?unavailable|gateway time-?out|access denied|server error)",
    r"(?:bad request|forbidden|not found|bad gateway|gateway time-?out|internal server error|service (?:temporarily )?unavailable|server error|method not allowed|unauthori[sz]ed|request time-?out|connection timed out)",
    r"(?:oops[,!.]* )?(?:(?:sorry|whoops)[,!.]* )?(?:(?:this|that|the|your) )?(?:requested )?(?:page|url|file|document|site|website|resource)(?: you (?:requested|are looking for|were looking for))? (?:(?:is|was|has|has been|could|can|does|cannot|can't|couldn't|isn't|wasn't|doesn't|no longer) ?)*(?:not |be |been |longer |no )*(?:found|gone|missing|exists?|removed|deleted|moved|available|unavailable)(?: on this server| here| anymore)?",
    r"(?:nothing|no page) (?:was )?found(?: here)?",
    r"index of /.{0,40}",
    r"(?:access|permission|request|zugriff|acceso|accès|acesso|dostęp|доступ)(?: was| is| has been)? (?:denied|forbidden|blocked|refused|rejected|verweigert|denegado|refusé|negado|zabroniony|запрещ[её]н)",
    r"(?:your )?(?:ip|ip address|request|connection|access|account|site|website|domain|user) (?:has been |was |is |temporarily |currently )*(?:blocked|banned|suspended|parked|disabled|expired|locked|rate[- ]limited|for sale|under construction|offline|down)(?: for .{0,30})?",
    r"(?:this )?(?:account|site|website|domain|page|shop|store)(?: is| has been)? (?:under construction|under maintenance|coming soon|temporarily (?:closed|unavailable)|parked|suspended)",
    r"too many requests|rate limit(?: was)? exceeded",
    r"(?:your )?(?:session|login|token)(?: has| is)? (?:expired|timed out|invalid)(?:[,.;!-]* ?(?:please )?(?:sign|log) in(?: again)?)?",
    r"(?:please )?(?:sign|log) in (?:again )?to continue",
    r"(?:an? )?(?:(?:unexpected|unknown|internal|application|fatal|database|server|client-side|runtime|critical|general|unhandled) )+(?:error|exception)(?:(?: has)? occurred|: .{1,60})?",
    r"(?:fatal|parse|syntax|type|uncaught|application) (?:error|exception): .{1,80}",
    r"something went wrong|whoops,? something went wrong|an error (?:has )?occurred",
    r"(?:error (?:establishing|connecting to) (?:an? )?(?:database|server)(?: connection)?)|(?:database|server|db) connection (?:failed|error|refused|lost)",
    r"(?:loading|please wait|redirecting|one moment(?:,? please)?|just a moment|hold on|checking)(?: ?\.{1,3}|…)?",
    r"(?:please )?(?:wait|stand by)(?: while| until)? we (?:are )?(?:verify|verifying|check|checking) (?:your|the) (?:browser|connection|request).{0,30}",
    r"(?:checking|verifying) (?:if )?(?:your|the) (?:browser|connection|site|you are human).{0,40}",
    r"(?:one more step|attention required|security check|verify|verification)(?:[:!, ]+(?:are you (?:a )?(?:human|robot)|you are (?:a )?human|.{0,20}captcha.{0,20}))?\??",
    r"are you (?:a )?(?:human|robot)\??|(?:i am|i'm) not a robot|(?:please )?(?:complete|solve) (?:the )?(?:captcha|security check).{0,30}",
    r"(?:please |you (?:need|have) to |you must )?(?:enable|activate|turn on|allow) (?:javascript|js|cookies|scripts?)(?:(?: and| or|,)+ (?:javascript|js|cookies|scripts?))*(?: (?:to|and|in) .{1,40})?",
    r"(?:this (?:page|site|app) (?:requires|needs) )?(?:javascript|js|cookies|scripts?)(?: and (?:cookies|javascript))? (?:is|are|must be) (?:required|disabled|turned off|needed|not enabled|enabled)(?: (?:to|for|in) .{1,40})?",
    r"your browser (?:does not|doesn't|is not|isn't) (?:support|supported|up to date).{0,40}|(?:unsupported|outdated) browser",
    r"(?:bitte )?(?:javascript|cookies) (?:aktivieren|einschalten|zulassen)|(?:veuillez|merci d')? ?activer (?:le )?(?:javascript|les cookies).{0,30}|(?:por favor,? )?(?:active|activa|habilite|habilita|ative) (?:el |o )?(?:javascript|cookies|las cookies).{0,30}|(?:пожалуйста, )?включите (?:javascript|cookies).{0,30}|(?:proszę )?włącz(?:yć)? (?:obsługę )?(?:javascript|cookies|ciasteczka).{0,30}",
    r"(?:die )?seite (?:wurde )?nicht gefunden|(?:la )?page (?:est )?(?:introuvable|non trouvée|inexistante)|(?:la )?página no (?:encontrada|existe|disponible)|(?:a )?página não (?:encontrada|existe)|страница не (?:найдена|существует)|(?:nie znaleziono strony|strona nie (?:została znaleziona|istnieje))|pagina non trovata|pagina niet gevonden|sidan hittades inte",
    r"(?:domain|site|website) (?:parked|for sale)|parked domain|buy this domain",
    r"this (?:domain|site|page) is (?:parked|for sale|blocked|private).{0,30}",
)

#: Filler and default titles.
FILLER = (
    r"(?:lorem )?(?:ipsum )?dolor sit amet(?:,? consectetur)?(?:,? adipiscing.{0,60})?|lorem ipsum(?: dolor.{0,80})?|consectetur adipiscing.{0,60}",
    r"untitled(?: ?(?:document|page|\d+|<num>))?|unbenannt(?:es dokument)?|sans titre|sin título|sem título|без названия|bez tytułu",
    r"new (?:page|document|site)(?: ?(?:\d+|<num>))?|page ?(?:\d+|<num>) title|document(?: ?(?:\d+|<num>))?|(?:my|just another) (?:demo |wordpress |new |first )*(?:site|website|blog|page|shop)",
    r"(?:your|my|page|site|sample|default|example|test|dummy|placeholder|insert|enter|add|put|type|write|set|change|replace)(?: (?:your|a|an|the|my|this|page|site|seo|meta|sample|default|example|post|article|product|blog))* (?:title|headline|heading|name|text|tagline)(?: (?:here|goes here|to be supplied|tbd|text|placeholder|- replace me|replace me))*",
    r"(?:title|headline|heading|name|text)(?: text)? (?:here|goes here|tbd|tba|todo|to be (?:supplied|added|done|written|determined|announced|defined)|placeholder|missing|needed)",
    r"(?:todo|tbd|tba|fixme|xxx)(?:[: -]+(?:write|add|set|fix|change|insert|fill|replace|update|title|text|name|copy)\b.{0,40})?|to be (?:done|supplied|written|determined|announced)",
    r"placeholder(?: (?:title|text|page))?(?: ?- ?replace me)?|no title|title",
    r"(?:titel|überschrift) hier(?: eingeben| einfügen)?|(?:beispiel|muster)titel|votre titre(?: ici)?|titre (?:ici|de la page|par défaut)|(?:tu|su|el) título(?: aquí)?|título (?:aquí|de (?:ejemplo|la página)|de exemplo)|(?:seu|o) título(?: aqui)?|(?:ваш )?заголовок(?: здесь)?|(?:twój |wpisz )?tytuł(?: tutaj)?",
    r"(?:(?:test|asdf|qwerty|foo|bar|baz|blah|bla|xxx+|abc|demo|sample|example|dummy)[ ,.-]*){2,}|(?:asdf|qwerty|blah|foo ?bar)\w*|x{3,}|test|demo",
    r"home ?page title|page name|site name|company name|website title|hello world",
)

#: Single words that are titles or notices, depending on the status.
EITHER = (
    "moved timeout outage service maintenance blocked limits limit closed gone error forbidden unavailable expired offline suspended parked denied "
    "redirect redirecting gateway access session verification security login captcha unauthorized restricted disabled removed deleted missing"
).split()

_EMPTY = re.compile(rf"(?:{EMPTY})(?:[ ,]+(?:{EMPTY}))*", re.I)
_MESSAGE = re.compile("|".join(f"(?:{p})" for p in (*NOTICES, *FILLER)), re.I)
_EITHER = re.compile("|".join(EITHER), re.I)
_TAIL = re.compile(r"(?:\s*(?:\((?:error |code |http )?\d{3}\)|[:;]-?[()/|]|[.!…]+))+$", re.I)
_SEPARATOR = re.compile(r"\s+(?:\||::|–|—|-|»|·|•|/)\s+|(?<=\S):\s+")


@lru_cache(1 << 15)
def _part(text: str) -> int:
    """2: a message, marker or filler; 1: either that or a title, by the status; 0: neither."""
    text = text.strip()
    short = _TAIL.sub("", text).strip()
    for form in dict.fromkeys((text, short, text.strip("\"'«»“”„*[]()").strip())):
        if form and (_EMPTY.fullmatch(form) or _MESSAGE.fullmatch(form)):
            return 2
    return 1 if _EITHER.fullmatch(short) else 0


def verdict(template: str) -> int:
    """2: a case, 1: a case if the status says so, 0: none. A site's name (one word) may stand before or after."""
    text = " ".join(template.split())
    if not text:
        return 0
    best = _part(text)
    if best == 2:
        return 2
    cuts = list(_SEPARATOR.finditer(text))
    for cut in dict.fromkeys(cuts[:1] + cuts[-1:]):
        left, right = text[: cut.start()], text[cut.end() :]
        if " " not in right and (a := _part(left)):
            # A single word is the whole title besides the site's name; a colon after it starts a phrase.
            best = max(best, a if a == 2 or not cut.group().startswith(":") else 0)
        if " " not in left and (b := _part(right)):
            best = max(best, b)
        if best < 2 and " " in left and " " in right and _part(left) == 2 and _part(right) == 2:
            best = 2
    return best


# --- Mining -----------------------------------------------------------------------------------------------------
_STATUS = re.compile(r"\W*[1-5]\d\d\W*")
_DIGITS = re.compile(r"\d")
_LETTERS = re.compile(r"[^\W\d_]+")


@cache
def _fragments() -> tuple[frozenset[str], tuple[str, ...]]:
    """The letter runs of all message patterns, and those long enough to be the beginning of a word."""
    plain = re.sub(r"\\[a-zA-Z]", " ", " ".join((EMPTY, *NOTICES, *FILLER, *EITHER)))
    runs = frozenset(_LETTERS.findall(plain.lower()))
    return runs, tuple(sorted(r for r in runs if len(r) >= 4))


@lru_cache(1 << 15)
def telling(word: str) -> bool:
    """Whether a word may matter to a pattern, so that no template leaves it open: it has a run of letters that a pattern has or begins with, or no letters but one at all."""
    runs, begins = _fragments()
    mine = _LETTERS.findall(word)
    return len(set("".join(mine))) < 2 or word in (SITE, NUMBER) or any(m in runs or m.startswith(begins) for m in mine)


def masked(title: str, website_url: str | None) -> list[str]:
    """The words of a title; its site's name and numbers other than status codes are masked."""
    host = (website_url or "").lower().split("//")[-1].split("/")[0].split(".")
    words = []
    for word in title.lower().split():
        bare = word.rstrip(":|.,")
        if len(bare) > 3 and bare in host:
            words.append(SITE + word[len(bare) :])
        elif _DIGITS.search(word) and not _STATUS.fullmatch(word):
            words.append(NUMBER)
        else:
            words.append(word)
    return words


def _mask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slots, words, kept = [], [], []
        for text, host in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            slots.append(has_slot(text))
            mine = [] if slots[-1] else masked(text, host)
            words.append(mine)
            kept.append([telling(w) for w in mine])
        yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), batch.column(3), pa.array(slots), pa.array(words, pa.list_(pa.string())), pa.array(kept, pa.list_(pa.bool_()))], ["id", "site", "failed", "slot", "words", "telling"])


def tree_templates(titles: DataFrame) -> DataFrame:
    """(words, site, failed, template) of distinct (words, site): the template of each title by a prefix tree of fixed depth.

    Below the root are the numbers of words, below those the first DEPTH words, level by level. A word is a branch
    of its own if it holds at least BRANCH of its parent's titles or may matter to a pattern; all others share
    the branch <*>. In a leaf, a later word stays if it may matter or if most of the leaf's titles have it there;
    the others are <*>. All shares are relative, counts are aggregates, and a leaf is never gathered anywhere.
    """
    rows = titles.groupBy("words", "site").agg(F.max("failed").alias("failed"), F.first("telling").alias("telling")).withColumns({"n": F.size("words"), "path": F.size("words").cast("string")})
    for level in range(1, DEPTH + 1):
        word = F.get("words", F.lit(level - 1))
        open_word = ~F.coalesce(F.get("telling", F.lit(level - 1)), F.lit(True))
        counts = rows.where(open_word).select("path", word.alias("w")).groupBy("path", "w").agg(F.count(F.lit(1)).alias("c"))
        totals = rows.groupBy("path").agg(F.count(F.lit(1)).alias("total"))
        branches = counts.join(totals, "path").where(F.col("c") >= F.col("total") * F.lit(BRANCH)).select("path", F.col("w").alias("branch"))
        joined = rows.withColumn("w", word).join(branches.withColumnRenamed("path", "p"), (F.col("path") == F.col("p")) & (F.col("w") == F.col("branch")), "left")
        step = F.when(word.isNull(), "").when(open_word & F.col("branch").isNull(), WILD).otherwise(word)
        rows = joined.withColumn("path", F.concat_ws(" ", "path", step)).drop("p", "branch", "w")
        rows = written(rows, f"tree{level}")
    places = rows.where(F.col("n") > DEPTH).select("path", F.posexplode(F.slice("words", F.lit(DEPTH + 1), F.col("n") - DEPTH)).alias("at", "w")).groupBy("path", "at", "w").agg(F.count(F.lit(1)).alias("c"))
    usual = places.groupBy("path", "at").agg(F.sum("c").alias("total"), F.max("c").alias("c"), F.max_by("w", "c").alias("w")).where(F.col("c") * 2 > F.col("total"))
    usual = usual.groupBy(F.col("path").alias("leaf")).agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("usual"))
    later = F.transform(
        F.slice("words", F.lit(DEPTH + 1), F.greatest(F.lit(0), F.col("n") - DEPTH)),
        lambda w, i: F.when(F.coalesce(F.get("telling", i + DEPTH), F.lit(True)) | F.coalesce(F.try_element_at("usual", i) == w, F.lit(False)), w).otherwise(WILD),
    )
    head = F.regexp_replace("path", r"^\d+ ?", "")
    template = F.trim(F.concat_ws(" ", head, F.array_join(later, " ")))
    return rows.join(usual, F.col("path") == F.col("leaf"), "left").select("words", "site", "failed", template.alias("template"))


def _classify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([verdict(t) for t in batch.column(0).to_pylist()], pa.int32())], ["template", "sites", "failed_sites", "verdict"])


def classified(placed: DataFrame) -> DataFrame:
    """(template, verdict) of the templates that are messages (2) or are so where the status says so (1), each template judged once.

    The fixed lists judge first. They also seed what is learned: a template that they don't know, found on at
    least SITES sites and without a site's name, is a message if its words are those of known messages rather than those
    of other templates (mean log-odds over templates), and depends on the status if most of its sites fail with it (lower
    bound of the share).
    """
    by_site = placed.groupBy("template", "site").agg(F.max("failed").alias("failed"))
    mined = by_site.groupBy("template").agg(F.count(F.lit(1)).alias("sites"), F.sum(F.col("failed").cast("long")).alias("failed_sites"))
    mined = written(mined.mapInArrow(_classify_batches, "template string, sites long, failed_sites long, verdict int"), "templates")
    unknown = mined.where((F.col("verdict") == 0) & (F.col("sites") >= SITES) & ~F.col("template").contains(SITE) & ~F.col("template").contains(WILD) & F.col("template").rlike(r"\p{L}"))
    words = F.array_distinct(F.regexp_extract_all("template", F.lit(r"(\p{L}{2,})")))
    asked = unknown.select("template", F.explode(words).alias("word"))
    known = mined.where("verdict <> 1").select(F.col("verdict"), F.explode(words).alias("word")).join(asked.select("word").distinct(), "word", "left_semi")
    use = known.groupBy("word").agg(F.count_if(F.col("verdict") == 2).alias("m"), F.count_if(F.col("verdict") == 0).alias("r"))
    # A template's own occurrence among the others says nothing about it.
    odds = F.log((F.col("m") + 0.5) / (F.greatest(F.col("r") - 1, F.lit(0)) + 0.5))
    all_odds = mined.agg(F.log((F.count_if(F.col("verdict") == 2) + 1.0) / (F.count_if(F.col("verdict") == 0) + 1.0)).alias("prior"))
    scored = asked.join(use, "word").groupBy("template").agg(F.avg(odds).alias("odds")).join(F.broadcast(all_odds))  # one row
    z2 = F.lit(4.0)
    share = F.col("failed_sites") / F.col("sites")
    low = (share + z2 / (2 * F.col("sites")) - 2 * F.sqrt(share * (1 - share) / F.col("sites") + z2 / (4 * F.col("sites") * F.col("sites")))) / (1 + z2 / F.col("sites"))
    learned = unknown.join(scored, "template", "left").select("template", F.when(F.col("odds") - F.col("prior") >= WORDING, 2).when(low >= 0.5, 1).otherwise(0).alias("verdict"))
    return mined.select("template", "verdict").unionByName(learned).where("verdict > 0")


def residue(pages: DataFrame, id_col: str = "webpage_id", title: str = "title", status: str = "status_code", site: str = "website_url") -> DataFrame:
    """(id, kind) of the rows whose title is no content; kind is 'slot', 'message' or 'status'.

    Message templates are mined with a prefix tree of fixed depth over all titles (tree_templates), each template is
    classified once (classified), and its verdict goes to all its titles; 'status' is a template that could be
    a title as well and a row of status 400 or more. Unresolved slots are found in every title itself. Null titles
    and titles of white space are none; an unknown status is not 400; repeated rows each count; very long titles
    are read whole; an empty table gives no rows; other columns are ignored.
    """
    source = pages.where(F.col(title).isNotNull()).select(F.col(title).cast("string").alias("title"), F.col(site).cast("string").alias("site"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(status) >= 400, F.lit(False)).alias("failed"))
    titles = written(spread(source).mapInArrow(_mask_batches, "id long, site string, failed boolean, slot boolean, words array<string>, telling array<boolean>"), "titles")
    placed = written(tree_templates(titles.where("not slot and size(words) > 0")), "placed")
    cases = placed.join(classified(placed), "template").groupBy("words", "verdict").agg(F.lit(1).alias("one")).groupBy("words").agg(F.max("verdict").alias("verdict"))
    messages = titles.where("not slot").join(cases, "words").where("verdict = 2 or failed").select(F.col("id"), F.when(F.col("verdict") == 2, "message").otherwise("status").alias("kind"))
    return titles.where("slot").select("id", F.lit("slot").alias("kind")).unionByName(messages).withColumnRenamed("id", id_col)


def titles_without_residue(pages: DataFrame, **options) -> DataFrame:
    """The rows of pages whose title is content or null."""
    id_col = options.get("id_col", "webpage_id")
    return pages.join(residue(pages, **options).select(id_col).distinct(), id_col, "left_anti")
