"""Which file of an album belongs to which track, by what is heard and by length (JOIN-18, DOM-42 to DOM-46, DOM-77).

files: album, file, track (that it is tagged as, or null), extra (in the folder, but no track of the album), heard (array of ids), titles (array of normal
titles heard), title (its own normal title), confirmed, seconds, forced (the user names it), displaced (the user put it off its track). tracks: album, track,
title (normal), length (null if unknown). All steps are joins on album and file or track; an album's files only ever meet its own tracks.

An unknown or zero length of a file counts as 0. Of several files that are tagged as one track, the last by name holds it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions import expr
from siftline.operators import dedupe

#: Fixed values, in seconds: a length this close fits; any other candidate must be further off than FAR; a file further off than SLACK isn't the track;
#: lengths of two tracks or files that differ by more than MARGIN tell them apart.
FIT, FAR, SLACK, MARGIN = 3, 6, 10, 3
FILE = ["album", "file"]
TRACK = ["album", "track"]


def evidence(own: Column, heard: Column, confirmed: Column) -> Column:
    """DOM-77: the titles that a file answers to: those heard, else its own one if it was confirmed."""
    return F.when(F.size(heard) > 0, heard).when(confirmed & expr.filled(own), F.array(own)).otherwise(F.array().cast("array<string>"))


def candidates(files: DataFrame, tracks: DataFrame, titles: Column) -> DataFrame:
    """JOIN-18: album, file, track, length of the tracks that a file's ids name, else of those whose title agrees with one of its titles."""
    by_id = files.select(*FILE, F.explode("heard").alias("track")).distinct().join(tracks.select(*TRACK, "length"), TRACK).select(*FILE, "track", "length")
    rest = files.join(by_id.select(*FILE).distinct(), FILE, "left_anti").select(*FILE, F.explode(titles).alias("answer"))
    named = rest.join(tracks.select(*TRACK, "title", "length"), "album").where(expr.titles_agree(F.col("title"), F.col("answer")))
    return by_id.unionByName(named.select(*FILE, "track", "length").distinct())


def _off(seconds: str, length: str) -> Column:
    return F.abs(F.coalesce(F.col(seconds), F.lit(0.0)) - F.col(length))


def assigned(items: DataFrame, tracks: DataFrame) -> DataFrame:
    """DOM-43, DOM-44: for each file of a track: holds (the track it is tagged as, if the album has it), state and to (its track). A file that fits its tag stays; else a
    single candidate takes it, or the only one whose length fits while all others are far off; a file that nothing is known of stays; one that fits no
    track is foreign; others are unclear. A file that would move onto a track whose own file stays is foreign, too."""
    own = items.join(tracks.select(*TRACK, F.col("track").alias("holds"), F.col("length").alias("held_length")), TRACK, "left")
    fits = candidates(items, tracks, F.col("titles")).join(own.select(*FILE, "holds", "seconds"), FILE)
    off = _off("seconds", "length")
    facts = fits.groupBy(*FILE).agg(
        F.count("*").alias("n"),
        F.max(F.col("track").eqNullSafe(F.col("holds"))).alias("right"),
        F.min("track").alias("only"),
        F.count_if(off <= FIT).alias("near"),
        F.count_if(off > FAR).alias("far"),
        F.count("length").alias("known"),
        F.min(F.when(off <= FIT, F.col("track"))).alias("nearest"),
    )
    both = own.join(facts, FILE, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    silent = (F.size("heard") == 0) & (F.size("titles") == 0)
    tie = (F.col("known") == F.col("n")) & (F.col("near") == 1) & (F.col("far") == F.col("n") - 1) & (F.coalesce("seconds", F.lit(0.0)) > 0)
    state = F.when(F.coalesce("right", F.lit(False)), "stays").when((F.col("n") == 1) | F.coalesce(tie, F.lit(False)), "moves").when(silent, "stays").when((F.col("n") == 0) & F.col("holds").isNotNull(), "foreign").otherwise("unclear")
    made = both.withColumn("state", state).withColumn("to", F.when(F.col("state") == "moves", F.when(F.col("n") == 1, F.col("only")).otherwise(F.col("nearest"))).when(F.col("state") == "stays", F.col("holds")))
    kept = made.where("state = 'stays' and to is not null").select("album", F.col("to"), F.lit(True).alias("kept")).distinct()
    lost = (F.col("state") == "moves") & F.col("kept").isNotNull() & F.col("holds").isNotNull()
    made = made.join(kept, ["album", "to"], "left").withColumn("state", F.when(lost, "foreign").otherwise(F.col("state")))
    return made.select(*FILE, "holds", "held_length", "seconds", "n", "state", F.when(F.col("state") != "foreign", F.col("to")).alias("to"))


class Plan:
    """DOM-43 to DOM-46: the changes of every album and what speaks against them."""

    def __init__(self, files: DataFrame, tracks: DataFrame):
        c = F.col
        items, extras = files.where(~c("extra")), files.where(c("extra"))
        own = dedupe.written(assigned(items, tracks), "assigned")
        lengths = tracks.select("album", c("track").alias("to"), c("length").alias("to_length"))
        moving = own.where("state = 'moves'")
        claimed = moving.select("album", c("to").alias("track"), F.lit(True).alias("claimed")).distinct()
        holders = own.where("holds is not null").groupBy("album", c("holds").alias("track")).agg(F.max(F.struct("file", "seconds", "state")).alias("holder"))
        open_ = extras.where(c("forced") | ~c("displaced"))
        titles = evidence(c("title"), c("titles"), c("confirmed"))
        named = dedupe.written(candidates(open_, tracks, titles), "named").groupBy(*FILE).agg(F.count("*").alias("n"), F.min("track").alias("track"))
        one = dedupe.written(open_.select(*FILE, "forced", "seconds").join(named.where("n = 1").drop("n"), FILE).join(tracks.select(*TRACK, "length"), TRACK), "one")
        held = one.join(holders, TRACK)
        held_fits = candidates(files, tracks, titles).select("album", c("file").alias("holder_file"), "track", F.lit(True).alias("holder_fits"))
        known = held.withColumn("holder_file", c("holder.file")).join(held_fits, ["album", "holder_file", "track"], "left").where(~c("holder.state").isin("moves", "foreign"))
        fits, mine, theirs = c("holder_fits").isNotNull(), _off("seconds", "length"), F.abs(F.coalesce("holder.seconds", F.lit(0.0)) - c("length"))
        better = F.when(c("forced"), True).when(c("length").isNull(), ~fits).when(fits, mine + MARGIN < theirs).otherwise(mine <= theirs + MARGIN)
        #: DOM-45: extras that are a track's audio while the file that holds it, and neither moves nor is foreign, is not, or is much further off.
        self.promoted = dedupe.written(known.where(better).select("album", "file", "track", c("holder.file").alias("replaces")), "promoted")

        foreign = own.where("state = 'foreign'").select("album", "file", c("holds").alias("track"), "seconds", c("held_length").alias("length")).join(claimed, TRACK, "left")
        off = _off("seconds", "length") > SLACK
        wanted = one.select(*TRACK, F.lit(True).alias("asked")).distinct()
        foreign = foreign.join(wanted, TRACK, "left").withColumn("state", F.when(c("claimed"), "demoted").when(F.coalesce(off, F.lit(False)), "vacates").when(c("asked"), "asked").otherwise("stuck"))
        foreign = dedupe.written(foreign, "foreign")
        empty = holders.where(c("holder.state") == "moves").join(claimed, TRACK, "left_anti").select(*TRACK)
        vacant = empty.unionAll(foreign.where("state in ('vacates', 'asked')").select(*TRACK)).distinct()
        good = one.where(c("forced") | F.coalesce(_off("seconds", "length") <= SLACK, F.lit(False)))
        takers = dedupe.written(vacant.join(good.groupBy(*TRACK).agg(F.count("*").alias("n"), F.min("file").alias("file")), TRACK, "left"), "takers")
        last = holders.select(*TRACK, c("holder.file").alias("holder"), c("holder.state").alias("holder_state"))
        filled = takers.where("n = 1").join(last, TRACK, "left")
        #: DOM-45: extras that take a track which its file leaves.
        self.filled = filled.select("album", "file", "track", F.when(c("holder_state") == "foreign", c("holder")).alias("replaces"))
        none = takers.where("n is null").select(*TRACK)
        short = last.join(none, TRACK).select("album", c("holder").alias("file")).join(foreign.where("state = 'asked'").select(*FILE), FILE)
        stuck = foreign.where("state = 'stuck'").select(*FILE).unionAll(short)
        replaced = self.filled.where("replaces is not null").select("album", c("replaces").alias("file"))
        #: DOM-45: foreign files that come off their track; those that an extra replaces aren't listed.
        self.demoted = foreign.join(stuck, FILE, "left_anti").join(replaced, FILE, "left_anti").select("album", "file", "track")
        self.moved = moving.select("album", "file", c("to").alias("track"), c("holds").alias("was"))

        two = moving.where("holds is not null").join(lengths, ["album", "to"]).where("to_length is not null and held_length is not null")
        doubtful = two.where((F.abs(c("to_length") - c("held_length")) > MARGIN) & (_off("seconds", "to_length") >= _off("seconds", "held_length")))
        goals = own.where("state in ('stays', 'moves') and to is not null").groupBy("album", "to").agg(F.count("*").alias("n")).where("n > 1")
        twice = self.promoted.groupBy(*TRACK).agg(F.count("*").alias("n")).where("n > 1")
        lost = files.where("forced").join(extras.select(*FILE), FILE, "left_anti")
        vague = extras.where("forced").join(named.where("n = 1").select(*FILE), FILE, "left_anti")
        problem = lambda rows, what, stays=False: rows.select("album", (c("file") if "file" in rows.columns else F.lit(None).cast("string")).cast("string").alias("file"), F.lit(what).alias("problem"), F.lit(stays).alias("stays")).distinct()
        #: DOM-46: what speaks against a plan; `stays` marks files that only stay where they are.
        self.problems = reduce(DataFrame.unionAll, [
            problem(own.where("state = 'unclear'"), "unclear"),
            problem(doubtful, "length"),
            problem(goals.select("album"), "two_files"),
            problem(twice.select("album"), "two_extras"),
            problem(lost, "not_an_extra"),
            problem(vague, "forced_unclear"),
            problem(foreign.where("state = 'stuck'"), "foreign_fits", True),
            problem(takers.where("n > 1").select("album", F.lit(None).cast("string").alias("file")), "several_extras"),
            problem(short, "extra_length"),
        ])

    def changes(self) -> DataFrame:
        """album, file, track, change (moves, promoted, fills, demoted) and the file that it replaces."""
        none = F.lit(None).cast("string")
        row = lambda rows, what, other=none: rows.select("album", F.col("file").cast("string").alias("file"), F.col("track").cast("string").alias("track"), F.lit(what).alias("change"), other.cast("string").alias("replaces"))
        return reduce(DataFrame.unionAll, [row(self.moved, "moves"), row(self.promoted, "promoted", F.col("replaces")), row(self.filled, "fills", F.col("replaces")), row(self.demoted, "demoted")])

    def gates(self, least_swaps: DataFrame) -> DataFrame:
        """DOM-46: for each album with changes: problems, those that count by hand (all but of files that only stay), and what the import may do by itself: relabel
        when nothing speaks against it and only moves or promotions are left over, else only note it; least_swaps (album): those with evidence of swaps."""
        kinds = self.changes().groupBy("album").agg(F.count("*").alias("changes"), F.count_if(F.col("change") == "moves").alias("moves"), F.count_if(F.col("change") == "promoted").alias("promotions"), F.count_if(F.col("change").isin("fills", "demoted")).alias("others"))
        bad = self.problems.groupBy("album").agg(F.count("*").alias("problems"), F.count_if(~F.col("stays")).alias("blocking"))
        out = kinds.join(bad, "album", "left").join(least_swaps.select("album", F.lit(True).alias("swapped")).distinct(), "album", "left").na.fill(0, ["problems", "blocking"])
        done = F.when(F.col("swapped").isNull() & (F.col("promotions") == 0), "nothing").when(F.col("problems") > 0, "noted").when(F.col("others") > 0, "noted").when(F.col("moves") > 0, "relabelled").otherwise("noted")
        return out.select("album", "changes", "problems", "blocking", done.alias("after_import"))


def promotable(files: DataFrame) -> DataFrame:
    """DOM-42: album and the number of extras that answer to the title of one of the album's own files."""
    titles = evidence(F.col("title"), F.col("titles"), F.col("confirmed"))
    own = files.where(~F.col("extra") & (F.col("title") != "")).select("album", F.col("title").alias("own")).distinct()
    heard = files.where("extra").select(*FILE, F.explode(titles).alias("answer"))
    return heard.join(own, "album").where(expr.titles_agree(F.col("answer"), F.col("own"))).groupBy("album").agg(F.count_distinct("file").alias("promotable"))
