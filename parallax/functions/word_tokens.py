"""P11 with the languages' own rules: abbreviations, apostrophes, protected patterns.

No rule but that of the final period, which is judged with the word that
follows, looks across a blank.  So the rules run over whole lines, in the JVM;
only a line that may hold an address, a tag or a path is cut into words first,
as such words stay as they are."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._col import as_col
from .text import PY_WHITESPACE, words

# Abbreviations whose period stays (a single capital letter always counts as one), and those whose period stays
# before a number, by language.  Parts of the public lists of non-breaking prefixes.
ABBREVIATIONS = {
    "en": "Adj Adm Adv Asst Bart Bldg Brig Bros Capt Cmdr Col Comdr Con Corp Cpl DR Dr Drs Ens Gen Gov Hon Hosp Hr Insp Lt MM MR MRS MS Maj "
          "Messrs Mlle Mme Mr Mrs Ms Msgr Op Ord Pfc Ph Prof Pvt Rep Reps Res Rev Rt Sen Sens Sfc Sgt Sr St Supt Surg e.g i.e rev v vs",
    "de": "Abb Abs Abt Anm Bd Co Dipl Dr Fa Fr Hr Hrn Hrsg Ing Jh Jhd Kap Mag Mio Mrd Nr Prof Sog St Std Str Tel abg allg bspw bzgl bzw ca d.h "
          "dt ebd etc evtl ff geb gegr gem ggf ggfs incl inkl max min o.ä s.o s.u sog u.a usw vgl z.B z.T zzgl",
    "es": "A.C Apdo Av Bco CC.AA Da Dep Dn Dr Dra EE.UU Excmo FF.CC Fil Gral J.C Let Lic N.B P.D P.V.P Prof Pts Rte S.A S.A.R S.E S.L S.R.C Sr "
          "Sra Srta Sta Sto T.V.E Tel Ud Uds V.B V.E Vd Vds adj admón afmo apdo av c.f c.g cap cm cta dcha doc ej entlo esq etc gr grs izq kg km "
          "mg mm p.a p.ej ptas pág págs vid vol",
    "fr": "Dr Ets MM Me Mgr Mlle Mlles Mme Mmes Mr Pr Prof St Ste Tél art av bd ca cf chap coll dép éd env etc ex fig hab ibid id p.ex réf "
          "suiv tél trad vol",
}
BEFORE_NUMBERS = {"en": "Art No Nos Nr pp", "de": "Art Nr S pp", "es": "art no núm nº pp", "fr": "art n no nos pp"}
#: languages in which an apostrophe between letters ends a word rather than beginning one
ELIDING = ("fr", "it", "ca", "ga")
#: words that stay as they are: addresses of pages and mail, tags, file names with a path
PROTECTED = r"(?:https?://\S+|www\.\S+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|<[^<>\s]+>|/?(?:[\w.-]+/)+[\w-]+\.\w{1,5})"

_PLAIN = r"^[\p{L}\p{N}]+$"


def _is(lang: Column, codes) -> Column:
    return lang.isin(*codes)


def _spaced(w: Column, lang: Column) -> Column:
    """A word, or words with blanks between them, with blanks around the punctuation."""
    out = F.regexp_replace(w, r"([^ \p{L}\p{M}\p{N}.'`,\-])", " $1 ")
    out = F.regexp_replace(out, r"(\.{2,})", " $1 ")
    out = F.regexp_replace(out, r",(?:(?<!\p{N},)|(?!\p{N}))", " , ")
    single = F.regexp_replace(out, r"'(?:(?!\p{L})|(?<![\p{L}\p{N}]'))", " ' ")
    return (F.when(lang == "en", F.regexp_replace(single, r"'(?:(?<=\p{L}')(?=\p{L})|(?<=\p{N}')(?=s))", " '"))
            .when(_is(lang, ELIDING), F.regexp_replace(single, r"'(?<=\p{L}')(?=\p{L})", "' "))
            .otherwise(F.replace(out, F.lit("'"), F.lit(" ' "))))


def _listed(table: dict[str, str], lang: Column, word: Column) -> Column:
    known = F.lit(False)
    for code, entries in table.items():
        known = known | ((lang == code) & word.isin(*entries.split()))
    return known


def _final_period(t: Column, after: Column, lang: Column) -> Column:
    """A word that ends with one period, without it where the period ends a sentence."""
    head = F.substring(t, F.lit(1), F.length(t) - 1)
    stays = ((F.contains(head, F.lit(".")) & head.rlike(r"\p{L}")) | head.rlike(r"^\p{Lu}$") | _listed(ABBREVIATIONS, lang, head)
             | F.coalesce(after.rlike(r"^\p{Ll}"), F.lit(False))
             | (_listed(BEFORE_NUMBERS, lang, head) & F.coalesce(after.rlike(r"^\p{N}"), F.lit(False))))
    ends = F.endswith(t, F.lit(".")) & (F.length(t) > 1) & ~F.endswith(head, F.lit(".")) & ~t.rlike(f"^{PROTECTED}$")
    return F.when(ends & ~stays, F.array(head, F.lit("."))).otherwise(F.array(t))


def _by_word(c: Column, code: Column) -> Column:
    """The tokens of a line cut into words first, protected words whole."""
    cut = F.transform(words(c), lambda w: F.when(w.rlike(_PLAIN) | w.rlike(f"^{PROTECTED}$"), F.array(w)).otherwise(
        F.array_remove(F.split(_spaced(w, code), " +"), "")))
    tokens = F.flatten(cut)
    pairs = F.arrays_zip(tokens.alias("t"), F.slice(F.concat(tokens, F.array(F.lit(""))), 2, F.size(tokens)).alias("after"))
    done = F.flatten(F.transform(pairs, lambda p: _final_period(p["t"], p["after"], code)))
    return F.array_join(done, " ")


def _ending(code: str) -> str:
    """The token whose one final period ends a sentence (``_final_period`` over a line of tokens)."""
    stays = [r"\p{Lu}\.(?![^ ])", r"(?=[^ ]*\p{L})[^ ]*\.[^ ]*\.(?![^ ])", r"[^ ]++ \p{Ll}"]
    for table, then in ((ABBREVIATIONS, "(?![^ ])"), (BEFORE_NUMBERS, r" \p{N}")):
        if code in table:
            stays.append(rf"(?:{'|'.join(map(re.escape, table[code].split()))})\.{then}")
    return rf"(?<![^ ])(?=[^ ]++(?<=[^ .]\.))(?!{'|'.join(stays)})([^ ]*)\.(?![^ ])"


def _by_line(c: Column, code: Column) -> Column:
    """The tokens of a line that holds no protected words."""
    spaced = F.translate(c, PY_WHITESPACE, " " * len(PY_WHITESPACE))
    tokens = F.trim(F.regexp_replace(_spaced(spaced, code), " {2,}", " "))
    done = F
    for lang in sorted({*ABBREVIATIONS, *BEFORE_NUMBERS}):
        done = done.when(code == lang, F.regexp_replace(tokens, _ending(lang), "$1 ."))
    return done.otherwise(F.regexp_replace(tokens, _ending(""), "$1 ."))


def tokenize_words(c, lang: str | Column = "en") -> Column:
    """The tokens of a line joined by blanks, by the rules of ``lang`` (a code or a column of codes).

    Punctuation and symbols are split off, commas outside numbers, runs of
    periods as one token, apostrophes as the language has them, and the
    period that ends a word unless the word is an abbreviation, holds other
    periods, or is followed by a small letter.  Addresses, tags and paths
    stay whole.  Languages without lists of their own have the general rules
    only; a null line is null."""
    code = F.lit(lang) if isinstance(lang, str) else F.coalesce(lang, F.lit(""))
    c = as_col(c)
    # every protected word holds one of these
    whole = F.contains(c, F.lit("/")) | F.contains(c, F.lit("@")) | F.contains(c, F.lit("<")) | F.contains(c, F.lit("www."))
    return F.when(whole, _by_word(c, code)).otherwise(_by_line(c, code))
