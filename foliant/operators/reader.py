"""The reader's documents: keyed reads, normal forms of stored state, marks and shares.

A store is a table of rows (owner, key, value json, updatedAt).  A point read is a
join with the keys that are asked for, so many are one job; what isn't there or
can't be parsed is an empty document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import c, squeeze, sub, text
from foliant.operators.sync import TABS, clamp_scroll, first_wins, latest, needs_gloss, share_valid

HIGHLIGHT = "struct<id:string,tab:string,block:int,start:int,end:int,text:string,createdAt:string>"
WORD = "struct<word:string,context:string,createdAt:string>"
FLAGS = "struct<reading:string,starred:boolean,cite:string,cited:boolean>"
DOCUMENT = f"note string, highlights array<{HIGHLIGHT}>, vocab array<{WORD}>, flags {FLAGS}, updatedAt string"
EXAMPLE = "struct<text:string,source:string,slug:string,title:string>"
ENTRY = f"word string, pos string, ipa string, en string, zh string, examples array<{EXAMPLE}>, updatedAt string"
SESSION = "slug string, title string, tab string, scroll double, progress map<string,string>, split string, at double"
# Fixed names: the two citation marks, and the schema of the account store.
TO_CITE, CITED = "待引用", "已引用"
STORE = {
    "meta": "key string not null, value string",
    "users": "id long not null, email string not null, display_name string, role string, disabled int, created_at string",
    "notes": "user_id long not null, slug string not null, data string, updated_at string",
    "kv": "user_id long not null, key string not null, data string, updated_at string",
    "shares": "token string not null, slug string not null, created_by long not null, created_at string, expires_at string, revoked int",
}
STORE_KEYS = {"meta": ["key"], "users": ["id"], "notes": ["user_id", "slug"], "kv": ["user_id", "key"], "shares": ["token"]}


# Keyed reads.


def by_key(rows: DataFrame, asked: DataFrame, keys: list[str], last: str | None = None, first: str | None = None) -> DataFrame:
    """The rows of the keys that are asked for; of repeated keys the last (or first) by that column."""
    rows = latest(rows, keys, last) if last else first_wins(rows, keys, first) if first else rows
    return asked.select(*keys).distinct().join(rows, keys)


def keys_under(store: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """Keys that begin with a prefix, without it."""
    return store.where(F.col(key).startswith(prefix)).select(F.col(key).substr(F.lit(len(prefix) + 1), F.length(key)).alias("slug"))


def notes_of(notes: DataFrame, user: Column | int) -> DataFrame:
    """slug, data, updated_at of one user's notes."""
    return notes.where(F.col("user_id") == user).select("slug", "data", "updated_at")


def documents(store: DataFrame, value: str = "value") -> DataFrame:
    """store with document: every field there, as it should be; empty where the text is missing or broken."""
    d = F.from_json(F.col(value), DOCUMENT)
    plain = F.struct(
        F.coalesce(d["note"], F.lit("")).alias("note"),
        F.coalesce(d["highlights"], F.array().cast(f"array<{HIGHLIGHT}>")).alias("highlights"),
        F.coalesce(d["vocab"], F.array().cast(f"array<{WORD}>")).alias("vocab"),
        normal_flags(d["flags"]).alias("flags"),
        F.coalesce(d["updatedAt"], F.lit("")).alias("updatedAt"),
    )
    return store.withColumn("document", plain)


def normal_flags(flags: Column) -> Column:
    """(reading, starred, cite): an old ``cited`` counts as cited unless a mark is set."""
    mark = F.when(flags["cite"].isin(TO_CITE, CITED), flags["cite"]).when(flags["cited"], CITED).otherwise("")
    return F.struct(F.coalesce(flags["reading"], F.lit("")).alias("reading"), F.coalesce(flags["starred"], F.lit(False)).alias("starred"), mark.alias("cite"))


def store_conflicts(rows: DataFrame, table: str) -> DataFrame:
    """Keys of a store's table that stand more than once, and addresses that several users have."""
    twice = lambda keys: rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("|", *[k.cast("string") for k in keys]).alias("key"), "n")
    out = twice([F.col(k) for k in STORE_KEYS[table]])
    return out.unionByName(twice([F.lower("email").alias("email")])) if table == "users" else out


# Sessions.


def normal_session(s: Column) -> Column:
    """A session (slug, title, tab, scroll, progress, split, at) in normal form; null without a slug.

    Positions of unknown tabs go; a position of its own is kept for the tab that has
    none; without a valid tab the first of those with a position is meant, else the article.
    """
    known = F.map_filter(F.coalesce(s["progress"], F.expr("cast(map() as map<string,string>)")), lambda k, v: k.isin(*TABS))
    progress = F.transform_values(known, lambda k, v: clamp_scroll(v))
    valid = F.coalesce(s["tab"].isin(*TABS), F.lit(False))
    own = F.map_from_arrays(F.array(s["tab"]), F.array(clamp_scroll(s["scroll"])))
    progress = F.when(valid & ~F.map_contains_key(progress, F.coalesce(s["tab"], F.lit(""))) & (s["scroll"] > 0), F.map_concat(progress, own)).otherwise(progress)
    tab = F.when(valid, s["tab"]).when(F.map_contains_key(progress, F.lit("articleEn")), "articleEn").when(F.map_contains_key(progress, F.lit("txt")), "txt").otherwise("article")
    scroll = F.coalesce(F.try_element_at(progress, tab), F.when(valid, clamp_scroll(s["scroll"])), F.lit(0))
    full = F.map_concat(F.map_filter(progress, lambda k, v: k != tab), F.map_from_arrays(F.array(tab), F.array(scroll)))
    out = F.struct(s["slug"].alias("slug"), text_of(s["title"]).alias("title"), tab.alias("tab"), scroll.alias("scroll"), full.alias("progress"), text_of(s["split"]).alias("split"), F.coalesce(s["at"], F.lit(0.0)).alias("at"))
    return F.when(text_of(s["slug"]) != "", out)


def text_of(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def recent_sessions(rows: DataFrame, owner: str, value: str = "value") -> DataFrame:
    """owner, pos, session of stored lists: of sessions, the first of each slug; or, as they once were, of slugs."""
    old = F.from_json(F.col(value), "array<string>")
    new = F.from_json(F.col(value), f"array<struct<{SESSION}>>")
    plain = F.regexp_like(F.coalesce(F.col(value), F.lit("")), F.lit(r'^\s*\[\s*"'))
    made = F.transform(old, lambda s: F.struct(s.alias("slug"), F.lit("").alias("title"), F.lit("article").alias("tab"), F.lit(0.0).alias("scroll"), F.expr("cast(map() as map<string,string>)").alias("progress"), F.lit("").alias("split"), F.lit(0.0).alias("at")))
    each = rows.select(owner, F.posexplode(F.when(plain, made).otherwise(new)).alias("pos", "s"))
    each = each.withColumn("session", normal_session(F.col("s"))).where("session is not null").withColumn("_slug", F.col("session.slug"))
    return first_wins(each, [owner, "_slug"], "pos").select(owner, "pos", "session")


def recent_slugs(sessions: DataFrame, owner: str) -> DataFrame:
    """owner, slugs in order.  A list has twelve entries at most."""
    return sessions.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "session.slug"))), lambda x: x["slug"]).alias("slugs"))


def paper_session(current: DataFrame, recents: DataFrame, asked: DataFrame, owner: str) -> DataFrame:
    """owner, slug, session: the current one if it is that paper's, else the one in the list."""
    key = [owner, "slug"]
    now = current.select(owner, F.col("session.slug").alias("slug"), F.col("session").alias("_a"))
    old = first_wins(recents.select(owner, F.col("session.slug").alias("slug"), F.col("session").alias("_b"), "pos"), key, "pos").drop("pos")
    both = asked.select(*key).join(now, key, "left").join(old, key, "left")
    return both.select(*key, F.coalesce("_a", "_b").alias("session"))


def snapshot(current: DataFrame, recents: DataFrame, owner: str) -> DataFrame:
    """owner, session, recent: what is sent to a server."""
    by_pos = lambda a, b: a["pos"] - b["pos"]
    r = recents.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "session")), by_pos), lambda x: x["session"]).alias("recent"))
    return current.select(owner, "session").join(r, owner, "full")


def kept_progress(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last position of each key (a trigger's debounce): a 0 before anything was scrolled, and what comes before ``ready``, is no position."""
    ok = F.col("ready") & ((F.col("scroll") > 0) | F.col("scrolled"))
    return latest(events.where(ok), key, order)


def overview(sessions: DataFrame, papers: DataFrame, owner: str, first: int = 6) -> tuple[DataFrame, DataFrame]:
    """(recent sessions of papers that exist, the first few papers by pos)."""
    return sessions.join(papers.select(F.col("slug").alias("_s")).distinct(), F.col("session.slug") == F.col("_s"), "left_semi"), papers.orderBy("pos").limit(first)


def is_reader_path(path: Column | str, slug: Column | str) -> Column:
    """The reader's address of a paper, or one below it."""
    top = F.concat(F.lit("/reader/"), c(slug))
    return (c(path) == top) | c(path).startswith(F.concat(top, F.lit("/")))


def vault_paths(folder: Column, pid: Column) -> Column:
    """Where a paper's files are."""
    at = lambda name, *p: F.concat(folder, F.lit("/"), *p).alias(name)
    part = lambda name, end: at(name, pid, F.lit("/content/"), pid, F.lit(end))
    return F.struct(folder.alias("folder"), at("index", pid, F.lit(".md")), part("article", ".正文.md"), part("articleEn", ".md"), part("notes", ".notes.md"), part("pdf", ".pdf"), part("txt", ".txt"))


# Vocabulary.


def normal_book(rows: DataFrame) -> DataFrame:
    """Entries with every field there; without a word they go."""
    return rows.select(*[text(x).alias(x) for x in ("word", "pos", "ipa", "en", "zh")], F.coalesce("examples", F.array().cast(rows.schema["examples"].dataType)).alias("examples"), text("updatedAt").alias("updatedAt")).where("word <> ''")


def book_latest(book: DataFrame) -> DataFrame:
    """One row: the last change of a whole book, or the empty text."""
    return book.agg(F.coalesce(F.max("updatedAt"), F.lit("")).alias("updatedAt"))


def lookup(book: DataFrame, words: DataFrame, ordinal: str = "ord") -> DataFrame:
    """words (word) with the entry of that word in any case, the last one, and whether it is glossed."""
    key = F.lower("word")
    last = latest(book.withColumn("_k", key), ["_k"], ordinal).drop("word", ordinal)
    out = words.withColumn("_k", key).join(last, "_k", "left").drop("_k")
    return out.withColumn("glossed", F.coalesce((text("en") != "") | (text("zh") != ""), F.lit(False)))


def pending(book: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Entries that lack a gloss, of those words if any are given."""
    todo = book.where(needs_gloss(F.col("en"), F.col("zh")))
    return todo if words is None else todo.withColumn("_k", F.lower("word")).join(words.select(F.lower("word").alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def gloss_list(raw: Column | str) -> Column:
    """The outermost JSON array in a model's answer, code fence or not; broken ones are empty."""
    x = sub(sub(text(raw), r"(?i)^```(?:json)?\s*"), r"\s*```$")
    schema = "array<struct<word:string,pos:string,ipa:string,en:string,zh:string>>"
    return F.coalesce(F.from_json(F.regexp_extract(x, r"(?s)(\[.*\])", 1), schema), F.array().cast(schema))


def mark_words(blocks: DataFrame, book: DataFrame, id_: str, column: str = "text") -> DataFrame:
    """id, start, word: whole words of the book in the texts, any case; of words that begin in one place the longest.

    The texts' own words are joined with the first words of the entries, so no text
    is tried against the whole book.
    """
    token = r"([A-Za-z][A-Za-z'’-]*)"
    entries = book.select(F.lower(squeeze("word")).alias("_e"), "word").where("_e <> ''").dropDuplicates(["_e"]).withColumn("_first", F.lower(F.regexp_extract("_e", token, 1))).where("_first <> ''")
    toks = blocks.select(id_, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(text(column), F.lit(token)), F.lower))).alias("_first"))
    both = toks.join(entries, "_first").join(blocks.select(id_, F.col(column).alias("_t")), id_)
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z])"), sub(F.col("_e"), r"([\\.\[\]{}()*+?^$|/-])", r"\\$1"), F.lit(r"(?![A-Za-z])"))
    # every place of the word: lengths of what stands between its hits
    pieces = F.split(F.col("_t"), pattern)
    width = F.length("_e")
    starts = F.transform(F.sequence(F.lit(0), F.size("_p") - 2), lambda i: F.aggregate(F.slice("_p", 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + i * width)
    hits = both.withColumn("_p", pieces).where(F.size("_p") > 1).select(id_, "word", width.alias("_w"), F.explode(starts).alias("start"))
    w = Window.partitionBy(id_).orderBy("start", F.desc("_w"))
    return hits.withColumn("_end", F.max(F.col("start") + F.col("_w")).over(w.rowsBetween(Window.unboundedPreceding, -1))).where("_end is null or start >= _end").select(id_, "start", "word")


# Marks of a document.


def without_highlights(highlights: DataFrame, ids: DataFrame) -> DataFrame:
    return highlights.join(ids.select("id").distinct(), "id", "left_anti")


def new_highlights(selections: DataFrame) -> DataFrame:
    """Selections whose ends lie in one block and that aren't blank, as highlights (start is the lesser end)."""
    ok = (F.col("startBlock") == F.col("endBlock")) & (F.trim(text("text")) != "") & (F.col("start") != F.col("end"))
    return selections.where(ok).select("slug", "tab", F.col("startBlock").alias("block"), F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), F.trim("text").alias("text"))


def without_words(vocab: DataFrame, gone: DataFrame) -> DataFrame:
    """Marks without the (word, context) pairs that go; a pair that isn't there takes all marks of its word."""
    key = lambda df: df.select("*", F.lower("word").alias("_w"), F.lower(squeeze(text("context"))).alias("_c"))
    v, g = key(vocab), key(gone).select("_w", "_c").distinct()
    whole = g.join(v.select("_w", "_c").distinct(), ["_w", "_c"], "left_anti").select("_w").distinct()
    return v.join(g, ["_w", "_c"], "left_anti").join(whole, "_w", "left_anti").select(*vocab.columns)


def imported(files: DataFrame, value: str = "value") -> DataFrame:
    """files with document (note, highlights, vocab) and ok: an export is taken if its note is text and both lists are lists; marks aren't taken."""
    x = F.col(value)
    kind = lambda f: F.coalesce(F.typeof(F.lit("")) == "string", F.lit(True)) & F.get_json_object(x, f"$.{f}").isNotNull()
    is_list = lambda f: F.coalesce(F.get_json_object(x, f"$.{f}").startswith("["), F.lit(False))
    as_text = F.regexp_like(F.coalesce(x, F.lit("")), F.lit(r'"note"\s*:\s*"'))
    d = F.from_json(x, DOCUMENT)
    note = sub(sub(text_of(d["note"]), r"(?is)<(script|style)[^>]*>.*?</\1>"), r"(?i)\son[a-z]+\s*=\s*(\"[^\"]*\"|'[^']*')")
    doc = F.struct(note.alias("note"), d["highlights"].alias("highlights"), d["vocab"].alias("vocab"))
    ok = kind("note") & as_text & is_list("highlights") & is_list("vocab")
    return files.withColumn("ok", ok).withColumn("document", F.when(ok, doc))


def exported(documents_: DataFrame, *fields: str) -> DataFrame:
    """value: each row's fields as JSON, nulls included."""
    return documents_.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def usage_in(terms: DataFrame, paper: DataFrame) -> DataFrame:
    """key, paper, context: the first usage of each term in the papers that are asked for."""
    u = terms.select("key", F.posexplode("usages").alias("pos", "u")).select("key", "pos", F.col("u.paper").alias("paper"), F.col("u.context").alias("context"))
    return first_wins(u.join(paper.select("paper").distinct(), "paper", "left_semi"), ["key", "paper"], "pos").select("key", "paper", "context")


# Accounts and shares.


def active_users(users: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Sessions (token, user_id, expires) that still run, of users that exist and aren't disabled."""
    run = sessions.where(F.col("expires") >= now)
    return run.join(users.where("coalesce(disabled, 0) = 0").withColumnRenamed("id", "user_id"), "user_id")


def issued(users: DataFrame, at: Column, days: int = 30) -> DataFrame:
    """user_id, issued, expires of new sessions."""
    return users.select(F.col("id").alias("user_id"), at.alias("issued"), (at + F.make_dt_interval(F.lit(days))).alias("expires"))


def admins(users: DataFrame) -> DataFrame:
    return users.where("role = 'admin'")


def in_order(users: DataFrame) -> DataFrame:
    return users.orderBy("id")


def patch_users(users: DataFrame, patches: DataFrame, admin: int) -> tuple[DataFrame, DataFrame]:
    """(users, rejected): names, roles and the disabled flag where a patch (id, display_name, role, disabled) has them.

    Rejected (id, why), and not applied at all: no such user, a role that isn't admin
    or reader, and the admin's own role or flag.
    """
    p = patches.alias("p").join(users.select(F.col("id").alias("_known")), F.col("id") == F.col("_known"), "left")
    why = (
        F.when(F.col("_known").isNull(), "unknown")
        .when(F.col("role").isNotNull() & ~F.col("role").isin("admin", "reader"), "role")
        .when(F.col("role").isNotNull() & (F.col("id") == admin), "own_role")
        .when(F.col("disabled").isNotNull() & (F.col("id") == admin), "own_flag")
    )
    judged = p.withColumn("why", why)
    good = judged.where("why is null").select("id", F.trim("display_name").alias("_n"), F.col("role").alias("_r"), F.col("disabled").cast("int").alias("_d"))
    out = users.join(good, "id", "left").withColumns({"display_name": F.coalesce("_n", "display_name"), "role": F.coalesce("_r", "role"), "disabled": F.coalesce("_d", "disabled")})
    return out.select(*users.columns), judged.where("why is not null").select("id", "why")


def change_passwords(users: DataFrame, changes: DataFrame, least: int = 6) -> tuple[DataFrame, DataFrame]:
    """(users, rejected): hashes replaced where the old one (id, old_hash, new_hash, length) is right and the new password long enough.  Hashing is the caller's."""
    both = changes.join(users.select("id", F.col("pass_hash").alias("_h")), "id", "left")
    why = F.when(~F.col("_h").eqNullSafe(F.col("old_hash")), "wrong").when(F.col("length") < least, "short")
    good = both.where(why.isNull()).select("id", "new_hash")
    return users.join(good, "id", "left").withColumn("pass_hash", F.coalesce("new_hash", "pass_hash")).select(*users.columns), both.where(why.isNotNull()).select("id", why.alias("why"))


def upsert_admin(users: DataFrame, admin: DataFrame) -> DataFrame:
    """Users with the admins of those addresses: known ones get the role and run again, others are added with ids above all."""
    a = admin.withColumn("_e", F.lower(F.trim("email"))).dropDuplicates(["_e"])
    u = users.withColumn("_e", F.lower("email")).join(a.select("_e", F.lit(True).alias("_hit")), "_e", "left")
    u = u.withColumns({"role": F.when(F.col("_hit"), "admin").otherwise(F.col("role")), "disabled": F.when(F.col("_hit"), 0).otherwise(F.col("disabled"))})
    top = users.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = a.join(users.select(F.lower("email").alias("_e")), "_e", "left_anti").crossJoin(F.broadcast(top))  # one row
    new = new.withColumns({"id": F.col("_top") + F.row_number().over(Window.orderBy("_e")), "role": F.lit("admin"), "disabled": F.lit(0)}).drop("_top", "_e")
    return u.drop("_e", "_hit").unionByName(new, allowMissingColumns=True).select(*users.columns)


def bootstrap(users: DataFrame, seed: DataFrame) -> DataFrame:
    """The users, or the seed where there are none."""
    return users.unionByName(seed, allowMissingColumns=True) if users.isEmpty() else users


def share_rows(shares: DataFrame) -> DataFrame:
    """Shares as their owner sees them."""
    return shares.select("token", "slug", F.col("created_at").alias("createdAt"), F.col("expires_at").alias("expiresAt"), F.col("revoked").cast("boolean").alias("revoked"))


def shares_of(shares: DataFrame, user: Column | int, slug: str | None = None) -> DataFrame:
    """A user's shares that weren't revoked, newest first; of one paper if it is named."""
    own = shares.where((F.col("created_by") == user) & (F.coalesce("revoked", F.lit(0)) == 0))
    return share_rows((own.where(F.col("slug") == slug) if slug else own).orderBy(F.desc("created_at"), "token"))


def with_share(listed: DataFrame, created: DataFrame, revoked: DataFrame) -> DataFrame:
    """A list of shares with the new ones, and without the tokens that were revoked."""
    return created.unionByName(listed, allowMissingColumns=True).join(revoked.select("token").distinct(), "token", "left_anti")


def share_pages(tokens: DataFrame, shares: DataFrame, papers: DataFrame, now: Column) -> DataFrame:
    """tokens with status and paper: 200 with the paper, or 410 if the share is unknown, over or revoked, or its paper gone."""
    s = shares.where(share_valid(F.col("revoked"), F.col("expires_at"), now)).select("token", "slug", F.col("expires_at").alias("expiresAt"))
    p = first_wins(papers, ["slug"], "pos").select("slug", "pid")
    both = tokens.select("token").join(s, "token", "left").join(p, "slug", "left")
    return both.select("token", F.when(F.col("pid").isNull(), 410).otherwise(200).alias("status"), "pid", "expiresAt")
