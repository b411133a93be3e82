"""Text functions over commit messages, diffs and patch files, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These patterns and limits decide which records are linked and must stay as they are.
#: White space, line borders and digits as Unicode text has them; both Java and RE2 read this.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same white space, character by character.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: ASCII letters in any case, with the four others that fold to them, digits and hyphen.
WORD = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}0-9-]"
TRAILER = (
    rf"(?i)^(?:{WORD}+:{SPACE}+.*"
    rf"|{WORD}+{SPACE}+#\p{{Nd}}+.*"
    r"|\(cherry picked from commit [a-f0-9]{40}\)"
    r"|\[.*\])$"
)
TAG = r"\(cherry picked from commit ([a-fA-F0-9]{40})\)"
INDEX_LINE = r"(?m)^index [0-9a-fA-F]+\.\.[0-9a-fA-F]+.*$\n?"
HUNK = r"@@ -\p{Nd}+(?:,\p{Nd}+)? \+\p{Nd}+(?:,\p{Nd}+)? @@"
GIT_HEADER = rf"(?im)^{SPACE}*Git-commit:{SPACE}*[\[<]?{SPACE}*([0-9a-f]{{40}}){SPACE}*[\]>]?"
ALT_HEADER = rf"(?im)^{SPACE}*Alt-commit:{SPACE}*[\[<]?{SPACE}*([0-9a-f]{{40}}){SPACE}*[\]>]?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_space(text: Column | str) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.trim(_col(text), F.lit(SPACES))


def normalize_phrase(text: Column | str) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(_col(text)), rf"{SPACE}+", " "))


def is_trailer(line: Column | str) -> Column:
    """Whether a stripped line is a trailer: a key with a value, an issue number, a tag or a note in brackets."""
    return F.rlike(_col(line), F.lit(TRAILER))


def strip_trailers(body: Column | str) -> Column:
    """A message without the trailers and blank lines at its end, as a normalised phrase.

    Lines are looked at from the last one up to the first that stays; those above are not.
    """
    lines = F.split(strip_space(F.coalesce(_col(body), F.lit(""))), LINE_BREAK)

    def goes(line: Column) -> Column:
        line = strip_space(line)
        return (line == "") | is_trailer(line)

    # lines counted off at the end; negative once one has stayed
    def step(found: Column, line: Column) -> Column:
        return F.when(found < 0, found).when(goes(line), found + 1).otherwise(-found - 1)

    found = F.aggregate(F.reverse(lines), F.lit(0), step)
    kept = F.when(found < 0, F.size(lines) + found + 1).otherwise(0)
    return normalize_phrase(F.array_join(F.slice(lines, F.lit(1), kept), " "))


def normalize_diff(diff: Column | str) -> Column:
    """A diff without blob index lines and hunk line numbers, stripped."""
    return strip_space(F.regexp_replace(F.regexp_replace(_col(diff), "(?d)" + INDEX_LINE, ""), HUNK, "@@"))


def picked_from(body: Column | str) -> Column:
    """The commit that the first cherry-pick tag names, lower-cased; null without a tag."""
    return F.lower(F.nullif(F.regexp_extract(_col(body), TAG, 1), F.lit("")))


def header_shas(text: Column | str, header: str) -> Column:
    """All commits that ``Git-commit:`` or ``Alt-commit:`` headers name, lower-cased, in order."""
    return F.transform(F.regexp_extract_all(_col(text), F.lit("(?d)" + header), F.lit(1)), F.lower)


def safe_long(text: Column | str) -> Column:
    """A whole number, or 0 if the text is none."""
    return F.coalesce(_col(text).try_cast("long"), F.lit(0).cast("long"))


def is_sha(text: Column | str) -> Column:
    return F.length(_col(text)) == 40


def sha_bytes(sha: Column | str) -> Column:
    return F.unhex(_col(sha))


def sha_text(raw: Column | str) -> Column:
    return F.lower(F.hex(_col(raw)))


def short_sha(sha: Column | str) -> Column:
    return F.substring(_col(sha), 1, 10)


def human_size(size: Column | str) -> Column:
    """Bytes in B to TB, by steps of 1024, two decimals."""
    size = _col(size).cast("double")
    out = F.format_string("%.2f TB", size / float(1 << 40))
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(size < float(1 << (10 * (k + 1))), F.format_string(f"%.2f {unit}", size / float(1 << (10 * k)))).otherwise(out)
    return out


#: Lines of a file's part of a diff that name no content: blob names, places of hunks, missing ends of line. UNIX lines, for content may hold carriage returns.
PLACE_LINE = r"(?md)^(?:index |@@ -|\\ ).*$"


def patch_id(diff: Column | str) -> Column:
    """What a raw diff changes, whatever the order of its files, white space, and where the lines stand; null for no file.

    Each file's part is a digest of its lines, hunks' places and blob names left out and white space removed; the parts are put in order.
    Diffs get equal ids if they get equal ones of git's ``patch-id --stable``.
    """
    parts = F.split(F.concat(F.lit("\n"), _col(diff)), "\ndiff --git ")
    files = F.slice(parts, 2, F.size(parts))
    named = F.transform(files, lambda part: F.sha1(F.regexp_replace(F.regexp_replace(part, PLACE_LINE, ""), "[ \\t-\\r]+", "")))
    return F.when(F.size(files) > 0, F.sha1(F.array_join(F.array_sort(named), "")))
