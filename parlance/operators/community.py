"""Reports on applications, members and their introductions, and the state changes behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.text import intro_text, row_hash

# Statuses of an application that count as filled in.
FILLED = ["pending", "vouched", "added", "rejected"]


def funnel(applications: DataFrame) -> DataFrame:
    return applications.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dashboard(applications: DataFrame) -> DataFrame:
    of = lambda *s: F.count_if(F.col("status").isin(*s))
    return applications.agg(F.count(F.lit(1)).alias("total"), of(*FILLED).alias("filled"), of("pending").alias("waiting"), of("added").alias("added"), of("rejected").alias("rejected"))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("_n = 1").drop("_n")


def members_overview(users: DataFrame, intros: DataFrame, applications: DataFrame) -> DataFrame:
    """Members with introduction date, and the name of who vouched for their latest vouched application."""
    vouched = latest(applications.where(F.col("voucher_id").isNotNull()), "user_id", ["created_at", "id"]).select("user_id", "voucher_id")
    names = users.select(F.col("user_id").alias("voucher_id"), F.col("name").alias("voucher_name"))
    members = users.where("is_member")
    return members.join(intros.select("user_id", "intro_at"), "user_id", "left").join(vouched, "user_id", "left").join(names, "voucher_id", "left").select("user_id", "name", "intro_at", "voucher_name")


def members_without_intro(users: DataFrame, intros: DataFrame) -> DataFrame:
    return users.where("is_member").join(intros.select("user_id"), "user_id", "left_anti")


def admin_stats(users: DataFrame, intros: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(users.where("is_member"), "members").crossJoin(one(intros, "intros")).crossJoin(one(members_without_intro(users, intros), "without_intro"))  # one row each


def status_counts(applications: DataFrame) -> DataFrame:
    """Applications by status, in the order of its name."""
    return funnel(applications).orderBy("status")


def messages_of(messages: DataFrame) -> DataFrame:
    """How many messages each sender has: what an erasure would touch."""
    return messages.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def surplus_pending(outbox: DataFrame) -> DataFrame:
    """One row: pending rows beyond the first of each application."""
    per = outbox.where("status = 'pending'").groupBy("application_id").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0")
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("surplus"))


def _first(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows in an order with their place from 1; a limit keeps what one task numbers small."""
    return rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(W.orderBy(*order)))


def members_by_name(users: DataFrame, limit: int = 10_000) -> DataFrame:
    """Members by name, then id, with their place."""
    return _first(users.where("is_member"), ["name", "user_id"], limit)


def unanswered_first(chats: DataFrame, key: str, limit: int = 10_000) -> DataFrame:
    """Chats (key, last_from_me, unread) with their place: those that wait for an answer first, those with more unread messages before others."""
    return _first(chats, ["last_from_me", F.desc("unread"), key], limit)


def upsert_intros(intros: DataFrame, incoming: DataFrame) -> DataFrame:
    """intros after incoming (user_id, intro_text, voucher, at): text and voucher are those of the last writer (ties: the greater text), all else
    stays; a user without an intro gets one, with nulls elsewhere."""
    last = incoming.groupBy("user_id").agg(F.max(F.struct("at", "intro_text", "voucher")).alias("_new"))
    d = intros.withColumn("_old", F.lit(True)).join(last, "user_id", "full")
    given = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("intro_text", "voucher")}
    return d.withColumns(given).select(*intros.columns)


def delete_intros(intros: DataFrame, users: DataFrame) -> DataFrame:
    """intros without those of users (user_id)."""
    return intros.join(users.select("user_id"), "user_id", "left_anti")


def overdue(applications: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Pending applications submitted (else created) more than so many hours before as_of."""
    return applications.where((F.col("status") == "pending") & (F.coalesce("submitted_at", "created_at") < as_of - F.make_interval(hours=F.lit(hours))))


def vouch_deadlines(applications: DataFrame, as_of: Column, reject_hours: int = 72, nudge_hours: int = 48) -> DataFrame:
    """id and action for pending applications: reject after the longer time since submission (else creation); else nudge and
    notify after the shorter one since creation, each if it hasn't been done."""
    age = lambda since, hours: since < as_of - F.make_interval(hours=F.lit(hours))
    late = age(F.coalesce("submitted_at", "created_at"), reject_hours)
    due = age(F.col("created_at"), nudge_hours)
    actions = F.when(late, F.array(F.lit("reject"))).when(due, F.filter(F.array(F.when(F.col("nudged_at").isNull(), "nudge"), F.when(F.col("notified_at").isNull(), "notify")), lambda x: x.isNotNull()))
    return applications.where("status = 'pending'").select("id", F.explode(actions).alias("action"))


def stale_intros(intros: DataFrame, as_of: Column, days: int) -> DataFrame:
    return intros.where(F.col("updated_at") < as_of - F.make_interval(days=F.lit(days)))


def refresh_step(phase: Column, sent: Column, age_days: Column) -> Column:
    """Struct of the next phase, and whether a reminder is due: daily up to five, then every second day up to eight, then
    done. age_days: whole days since the last reminder, null if there was none."""
    since = lambda days: F.coalesce(age_days >= days, F.lit(True))
    daily = F.coalesce(phase, F.lit("daily")) == "daily"
    sent = F.coalesce(sent, F.lit(0))
    next_ = F.when((phase == "done"), "done").when(daily & (sent < 5), "daily").when(sent < 8, "every_2_days").otherwise("done")
    return F.struct(next_.alias("phase"), F.when(next_ == "daily", since(1)).when(next_ == "every_2_days", since(2)).otherwise(False).alias("due"))


def search_members(users: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Substring in any of the columns, in any case; % and _ in needle keep their meaning."""
    match = F.lit(False)
    for c in columns:
        match = match | F.coalesce(F.col(c).ilike(f"%{needle}%"), F.lit(False))
    return users.where(match)


def one_pending(outbox: DataFrame) -> DataFrame:
    """Of an application's pending rows the first; others as they are."""
    n = F.row_number().over(W.partitionBy("application_id").orderBy("created_at", "id"))
    return outbox.where("status <> 'pending'").unionByName(outbox.where("status = 'pending'").withColumn("_n", n).where("_n = 1").drop("_n"))


def after_attempt(outbox: DataFrame, most: int = 5, length: int = 500) -> DataFrame:
    """attempts, last_error and status after a failed attempt with error."""
    n = F.col("attempts") + 1
    return outbox.withColumns({"attempts": n, "last_error": F.substring("error", 1, length), "status": F.when(n >= most, "failed").otherwise(F.col("status"))})


def answers_wide(answers: DataFrame, questions: int = 7) -> DataFrame:
    """One row per user: the current answer to each question, a dash where there is none."""
    of = lambda k: F.coalesce(F.max(F.when(F.col("is_current") & (F.col("question_index") == k), F.col("answer"))), F.lit("—")).alias(f"q{k}")
    return answers.groupBy("user_id").agg(*[of(k) for k in range(questions)])


def numbered(rows: DataFrame, key: str, name: str, block: int = 10_000) -> DataFrame:
    """rows with their number from 1 by key (whole numbers) under name: numbers inside blocks of keys, after the sums of the blocks before.
    The sums are a row for each block, in one task."""
    d = rows.withColumn("_block", F.floor(F.col(key) / block))
    sums = d.groupBy("_block").agg(F.count(F.lit(1)).alias("_rows"))
    before = sums.select(F.col("_block").alias("_of"), F.coalesce(F.sum("_rows").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_block").orderBy(key))
    return d.withColumn("_inside", inside).join(before, F.col("_block") == F.col("_of")).withColumn(name, F.col("_inside") + F.col("_before")).drop("_block", "_of", "_before", "_inside")


def sheet_changes(sheet: DataFrame, local: DataFrame) -> DataFrame:
    """Users of both whose rows differ; the sheet wins. Both: user_id, row_hash."""
    return sheet.join(local.select("user_id", F.col("row_hash").alias("local_hash")), "user_id").where(F.col("row_hash") != F.col("local_hash")).select("user_id", "row_hash")


# What the sheet's last column says.
HAS_INTRO, NO_INTRO = "есть интро", "нет интро"


def sync_sheet(sheet: DataFrame, intros: DataFrame, users: DataFrame, answers: DataFrame, template: str, as_of: Column, questions: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sheet, intros and answers after one sync both ways.

    sheet: row_number, user_id, username, q0 to q6, voucher, status. intros: user_id, intro_text, voucher, row_number, synced_at. answers: user_id,
    question_index, answer, is_current. 1. Intros without a row number get the row of their user, or a new one at the end (by user_id). 2. Where
    a row's answers differ from the current ones the sheet wins: existing current answers and the intro's text and (if the sheet names one) voucher
    change. 3. The status says whether the user has an intro.
    """
    qs = [f"q{k}" for k in range(questions)]
    current = answers.where("is_current").groupBy("user_id").agg(*[F.max(F.when(F.col("question_index") == k, F.col("answer"))).alias(q) for k, q in enumerate(qs)])
    first_row = sheet.groupBy("user_id").agg(F.min("row_number").alias("_row"))
    pushed = intros.where(F.col("row_number").isNull()).join(users.select("user_id", F.col("username").alias("_name")), "user_id")
    pushed = pushed.drop("row_number").join(first_row, "user_id", "left").join(current, "user_id", "left")
    end = sheet.agg(F.coalesce(F.max("row_number"), F.lit(1)).alias("_end"))  # one row
    fresh = numbered(pushed.where(F.col("_row").isNull()).select("user_id"), "user_id", "_n").join(F.broadcast(end)).select("user_id", (F.col("_end") + F.col("_n")).alias("_new"))
    pushed = pushed.join(fresh, "user_id", "left").withColumn("row_number", F.coalesce("_row", "_new").cast("long"))
    name = F.coalesce(F.concat(F.lit("@"), "_name"), F.lit(""))
    rows = pushed.select("row_number", "user_id", name.alias("username"), *[F.coalesce(q, F.lit("")).alias(q) for q in qs], F.coalesce("voucher", F.lit("")).alias("voucher"), F.lit(HAS_INTRO).alias("status"))
    whole = sheet.join(rows.select("row_number"), "row_number", "left_anti").unionByName(rows)
    status = intros.select("user_id", F.lit(HAS_INTRO).alias("_status")).distinct()
    whole = whole.join(status, "user_id", "left").withColumn("status", F.coalesce("_status", F.lit(NO_INTRO))).select(*sheet.columns)
    # Of several rows of one user the last one counts.
    said = whole.groupBy("user_id").agg(F.max_by(F.struct("row_number", *qs, "voucher"), "row_number").alias("s"))
    d = intros.join(said, "user_id", "left").join(current, "user_id", "left")
    cells, own = [F.coalesce(F.col(f"s.{q}"), F.lit("")) for q in qs], [F.coalesce(q, F.lit("")) for q in qs]
    differs = F.col("s").isNotNull() & (row_hash(*cells) != row_hash(*own))
    named = F.trim(F.coalesce("s.voucher", F.lit("")))
    after = d.select(
        "user_id",
        F.when(differs, intro_text(template, cells)).otherwise(F.col("intro_text")).alias("intro_text"),
        F.when(differs & (named != ""), named).otherwise(F.col("voucher")).alias("voucher"),
        F.coalesce("s.row_number", "row_number").alias("row_number"),
        F.when(differs | F.col("row_number").isNull(), as_of).otherwise(F.col("synced_at")).alias("synced_at"),
    )
    told = d.where(differs).select("user_id", F.posexplode(F.array(*cells)).alias("question_index", "_said"))
    new = answers.join(told, ["user_id", "question_index"], "left").withColumn("answer", F.when(F.col("is_current") & F.col("_said").isNotNull(), F.trim("_said")).otherwise(F.col("answer"))).select(*answers.columns)
    return whole, after, new


def compare_and_set(applications: DataFrame, actions: DataFrame) -> DataFrame:
    """applications after actions (id, seq, expected, new_status): of an application's actions the first whose expectation holds."""
    fits = actions.join(applications.select("id", "status"), "id").where("status = expected")
    first = fits.groupBy("id").agg(F.min_by("new_status", "seq").alias("new_status"))
    return applications.join(first, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def admission(has_application: Column, status: Column, invited: Column, user: Column) -> Column:
    """Whether a user's active application lets them in: ok, or why not."""
    return F.when(~has_application, "no_application").when(F.coalesce(status != "vouched", F.lit(True)), "wrong_status").when(invited.isNull() | (invited != user), "wrong_user").otherwise("ok")


# Statuses of a chat's member, inside and outside of it.
INSIDE, OUTSIDE = ["member", "administrator", "creator"], ["left", "kicked"]


def membership_changes(changes: DataFrame) -> DataFrame:
    """changes (old_status, new_status, ...) that are a join or a leave, with change. Restricted members count as outside before a
    join, but becoming restricted is no leave."""
    old, new = F.col("old_status"), F.col("new_status")
    change = F.when(old.isin(*OUTSIDE, "restricted") & new.isin(*INSIDE), "joined").when(old.isin(*INSIDE) & new.isin(*OUTSIDE), "left")
    return changes.withColumn("change", change).where("change is not null")


def apply_membership(users: DataFrame, applications: DataFrame, intros: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """users (user_id, is_member, is_admin, joined_at, left_at), applications (id, user_id, status, invite_user_id, created_at, added_at) and
    intros to be written (user_id, application_id) after the last change of each user (user_id, old_status, new_status, at), and rejected joins
    (user_id, reason, first_time).

    Admins may join without an application; others need one that is vouched for and invites them. A join that isn't
    admitted leaves the user outside with left_at; it is the first if there was none before. Who has an intro keeps it.
    """
    last = membership_changes(changes).withColumn("_n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("at"), F.desc("change")))).where("_n = 1").select("user_id", "change", "at")
    active = latest(applications.where(F.col("status").isin("filling", "pending", "vouched", "privacy_block")), "user_id", ["created_at", "id"])
    active = active.select(F.col("user_id").alias("_a_user"), F.col("id").alias("application_id"), F.col("status").alias("_a_status"), "invite_user_id")
    d = users.join(last, "user_id", "left").join(active, F.col("user_id") == F.col("_a_user"), "left")
    reason = F.when(F.col("is_admin"), "ok").otherwise(admission(F.col("application_id").isNotNull(), F.col("_a_status"), F.col("invite_user_id"), F.col("user_id")))
    d = d.withColumn("_reason", F.when(F.col("change") == "joined", reason))
    entered, gone = F.coalesce(F.col("_reason") == "ok", F.lit(False)), F.coalesce((F.col("change") == "left") | (F.col("_reason") != "ok"), F.lit(False))
    after = d.select(
        *[c for c in users.columns if c not in ("is_member", "joined_at", "left_at")],
        F.when(entered, True).when(gone, False).otherwise(F.col("is_member")).alias("is_member"),
        F.when(entered, F.col("at")).otherwise(F.col("joined_at")).alias("joined_at"),
        F.when(gone, F.col("at")).otherwise(F.col("left_at")).alias("left_at"),
    )
    added = d.where(entered & ~F.col("is_admin")).select("user_id", "application_id", "at").join(intros.select("user_id"), "user_id", "left_anti")
    apps = applications.join(added.select(F.col("application_id").alias("id"), F.col("at").alias("_at")), "id", "left")
    apps = apps.withColumn("status", F.when(F.col("_at").isNotNull(), "added").otherwise(F.col("status"))).withColumn("added_at", F.coalesce("_at", "added_at")).select(*applications.columns)
    rejected = d.where("_reason <> 'ok'").select("user_id", F.col("_reason").alias("reason"), F.col("left_at").isNull().alias("first_time"))
    return after.select(*users.columns), apps, added.select("user_id", "application_id"), rejected


# What a questionnaire's actions do to an application: action, status it needs (null: any), new status.
APPLICATION_STEPS = [("confirm", None, "pending"), ("confirm_member", None, "added"), ("refresh", None, "added"), ("ready", "privacy_block", "vouched"), ("vouch", "pending", "vouched"), ("reject", "pending", "rejected")]


def apply_actions(applications: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """applications (id, user_id, status, submitted_at, invite_user_id) after the first action of each that its status allows (id, actor,
    action, seq, at), and the actions with done.

    Confirming sets submitted_at; vouching and being ready set the invited user. One can't vouch for oneself, and only the applicant is ready.
    """
    steps = F.create_map(*[F.lit(x) for a, need, to in APPLICATION_STEPS for x in (a, f"{need or ''}>{to}")])
    a = applications.select("id", F.col("user_id").alias("_user"), F.col("status").alias("_status"))
    step = F.split(F.try_element_at(steps, F.col("action")), ">")
    needed = F.get(step, F.lit(0))
    own = F.col("actor") == F.col("_user")
    allowed = ((needed == "") | (needed == F.col("_status"))) & F.when(F.col("action") == "ready", own).when(F.col("action") == "vouch", ~own).otherwise(True)
    judged = actions.join(a, "id", "left").withColumn("_fits", F.coalesce(allowed, F.lit(False))).withColumn("_to", F.get(step, F.lit(1)))
    first = F.row_number().over(W.partitionBy("id").orderBy(F.desc("_fits"), "seq"))
    judged = judged.withColumn("done", F.col("_fits") & (first == 1))
    done = judged.where("done").select("id", F.col("_to"), F.col("action").alias("_action"), F.col("at").alias("_at"))
    d = applications.join(done, "id", "left")
    d = d.withColumns(
        {
            "status": F.coalesce("_to", "status"),
            "submitted_at": F.when(F.col("_action") == "confirm", F.col("_at")).otherwise(F.col("submitted_at")),
            "invite_user_id": F.when(F.col("_action").isin("vouch", "ready"), F.col("user_id")).otherwise(F.col("invite_user_id")),
        }
    )
    return d.select(*applications.columns), judged.select(*actions.columns, "done")


def set_member(users: DataFrame, changes: DataFrame) -> DataFrame:
    """users after changes (user_id, is_member, joined_at, left_at), one per user; times given as null stay."""
    c = changes.select("user_id", *[F.col(x).alias(f"_{x}") for x in ("is_member", "joined_at", "left_at")])
    d = users.join(c, "user_id", "left")
    return d.withColumns({x: F.coalesce(f"_{x}", x) for x in ("is_member", "joined_at", "left_at")}).select(*users.columns)


def retire_answers(answers: DataFrame, users: DataFrame, delete: bool = False) -> DataFrame:
    """answers of users (user_id, application_id; null: all) not current any more, or gone."""
    u = users.select(F.col("user_id").alias("_u"), F.col("application_id").alias("_a")).distinct()
    same = (F.col("user_id") == F.col("_u")) & (F.col("_a").isNull() | (F.col("application_id") == F.col("_a")))
    if delete:
        return answers.join(u, same, "left_anti")
    hit = answers.join(u, same, "left_semi").withColumn("is_current", F.lit(False))
    return answers.join(u, same, "left_anti").unionByName(hit)


def last_answered(answers: DataFrame) -> DataFrame:
    return answers.groupBy("user_id", "application_id").agg(F.max("question_index").alias("last_index"))


def next_in_outbox(outbox: DataFrame, limit: int = 10) -> DataFrame:
    """Pending rows to be sent next, by id."""
    return outbox.where("status = 'pending'").orderBy("id").limit(limit)


def append_pending(outbox: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """outbox with new rows (application_id, ...), and those refused as their application has a pending row already."""
    pending = outbox.where("status = 'pending'").select("application_id")
    first = new.withColumn("_n", F.row_number().over(W.partitionBy("application_id").orderBy("id")))
    fine = first.where("_n = 1").drop("_n").join(pending, "application_id", "left_anti").select(*new.columns)
    refused = first.where("_n > 1").drop("_n").unionByName(first.where("_n = 1").drop("_n").join(pending, "application_id", "left_semi").select(*new.columns))
    return outbox.unionByName(fine.withColumn("status", F.lit("pending")), allowMissingColumns=True), refused.select(*new.columns)


def forward_lookup(texts: DataFrame, messages: DataFrame, users: DataFrame, intros: DataFrame) -> DataFrame:
    """query_id, found (nothing, no_intro, intro), user_id, intro_text: who wrote exactly that text last (ties: the greater id)."""
    # The last author of each text first, so that equal texts don't meet in pairs.
    asked = texts.where("text <> ''").select("query_id", F.sha2("text", 256).alias("_digest"))
    said = messages.select(F.sha2("text", 256).alias("_text"), "user_id", F.struct("captured_at", "message_id").alias("_order"))
    last = said.groupBy("_text").agg(F.max_by("user_id", "_order").alias("user_id"))
    hit = asked.join(last, F.col("_digest") == F.col("_text")).select("query_id", "user_id")
    d = texts.select("query_id").join(hit, "query_id", "left").join(users.select("user_id", F.lit(True).alias("_known")), "user_id", "left").join(intros.select("user_id", "intro_text"), "user_id", "left")
    found = F.when(F.col("_known").isNull(), "nothing").when(F.col("intro_text").isNull(), "no_intro").otherwise("intro")
    return d.select("query_id", found.alias("found"), F.when(F.col("_known"), F.col("user_id")).alias("user_id"), "intro_text")


def health_deltas(samples: DataFrame) -> DataFrame:
    """samples (host, ts, status, restarts, pending) with d_restarts, d_pending and state: red when the status begins with exited:, restarts rose
    by more than two, or more than fifty are pending and rising; else green."""
    w = W.partitionBy("host").orderBy("ts")
    d = samples.withColumn("d_restarts", F.col("restarts") - F.lag("restarts").over(w)).withColumn("d_pending", F.col("pending") - F.lag("pending").over(w))
    red = F.coalesce(F.col("status").startswith("exited:"), F.lit(False)) | (F.coalesce("d_restarts", F.lit(0)) > 2) | ((F.col("pending") > 50) & (F.coalesce("d_pending", F.lit(0)) > 0))
    return d.withColumn("state", F.when(red, "red").otherwise("green"))
