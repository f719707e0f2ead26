"""Problem 5: broken prompt and response pairs, by ordered rules over whole texts.

The rules, in their order: nothing said; a refusal; the question given back; another script or language than the
question's; a text that breaks off (unclosed delimiters, abrupt endings). Every rule that holds emits its defect; an empty
answer leaves nothing for the others to judge, and a question given back to its last word has not broken off.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from vouchline.llm.candidates import as_object, cut, folded

DEFECTS = ("empty_answer", "truncated_answer", "refusal", "copied_question", "other_language")

# What stands for an answer without being one, folded and without signs around it.
PLACEHOLDERS = frozenset(
    "none|null|nil|nan|na|n/a|tbd|tba|tbc|todo|blank|empty|missing|unknown|undefined|void|answer|question|response|reply|"
    "placeholder|pending|xxx|lorem ipsum|no answer|not available|not applicable|no response|to be determined|to be done|"
    "to be added|answer goes here|your answer here|insert answer|keine antwort|entfällt|k.a|sans réponse|pas de réponse|"
    "aucune réponse|sin respuesta|ninguna respuesta|sem resposta|geen antwoord".split("|")
)

# Frequent words of six languages, without accents.
LANGUAGES = {
    "en": "the of and to in is are was were be been that this which with for from by on at as it its not or if only what how has have had would should may must when where who whom there their they these those an a over about before after because than then does do",
    "de": "der die das den dem des und oder nicht ist sind war wird werden wurde ein eine einen einem einer eines mit von zu zum zur im am auf fur bei nach aus uber unter durch ob wenn dass sich sie es er wir ich zwei noch auch nur wie was welche sofern weil falls danach muss soll sollen haben hat kann keine kein mich diese dieser dieses",
    "fr": "le la les un une des du de et ou ne pas est sont etait sera au aux avec pour par sur dans que qui quoi ce cette ces il elle ils elles on nous vous je si lorsque quand car mais plus son sa ses leur leurs ensuite doit faut s'il d'un d'une puis apres avant encore savoir deux a l'auditeur",
    "es": "el la los las un una unos unas de del y o no es son fue sera al con para por sobre en que quien cual este esta estos estas se su sus si cuando porque pero mas como donde debe deben hay despues antes otra vez queda segun lo le les ya muy dos ha han",
    "pt": "o a os as um uma uns umas de do da dos das e ou nao e sao foi sera ao aos com para por sobre em no na nos nas que quem qual este esta estes estas se seu sua seus suas quando porque mas mais como onde deve devem ha depois antes outra vez pelo pela ja muito dois duas foram",
    "nl": "de het een en of niet is zijn was werd wordt worden aan met voor door op in van naar bij uit over onder dat die deze dit hij zij wij ik u als wanneer omdat maar meer er nog ook moet moeten heeft hebben kan geen om te tot pas daarna alleen wat hoe welke",
}
# The same of languages in which answers, but not the pages of the corpus, may be written.
OTHERS = {
    "it": "il lo gli uno una di del della dei delle dello che non con per sono era sara nel nella sul sulla questo questa quale come quando perche anche piu dal dalla deve devono essere stato stata viene si ma",
    "da": "og det den der til af ikke er var har vil med fra som ved ogsa hvis hvad hvor nar fordi skal kan bliver blev efter eller denne dette disse jeg vi sig et en",
    "sv": "och det den som till av inte ar var har vill med fran vid ocksa om vad hur nar eftersom ska kan blir blev efter eller denna detta dessa jag vi sig ett en",
    "pl": "i nie jest sie na do ze to w z o jak ale przez dla po od czy tylko lub oraz ktory ktora ktore byl byla bylo jego jej ich moze musi",
}
_languages: dict[str, tuple[str, ...]] = {}
for _name, _listed in {**LANGUAGES, **OTHERS}.items():
    for _word in _listed.split():
        _languages[_word] = (*_languages.get(_word, ()), _name)

# What declining to answer sounds like, per sentence, in folded text. Subjects outside the assistant
# (a bank, an auditor, a preparer) don't refuse the question. The parts of a refusal lie within 200 signs of each other.
_CANNOT = r"(?:can ?not|can'?t|could not|couldn'?t|am unable|'m unable|am not able|'m not able|are unable|are not able|will not|won'?t|would not|must decline|decline|have to decline|refuse|would rather not|'d rather not|prefer not|do not wish|am not permitted|'m not permitted|am not allowed|'m not allowed|may not|am not in a position|'m not in a position|do not feel comfortable|don'?t feel comfortable|have to pass|must pass|have no view|have no opinion|have no comment|am not authori[sz]ed|do not let me|don'?t let me|does not let me)"
_SAY = r"(?:answer|answering|help|assist|comment|discuss|respond|reply|provide|give|giving|say|advise|offer|complete|fulfil|fulfill|address|share|tell|guidance|advice|question|request|view|opinion|conclusion|that|this)"
REFUSALS = [
    rf"\b(?:i|we)(?: \w+){{0,2}} ?{_CANNOT}(?: \S+){{0,6}}? ?\b{_SAY}\b",
    rf"\bi ?{_CANNOT}\s*[.!]?$",
    r"\bas an? (?:\w+ )?(?:assistant|helper|model|ai|language model|chatbot|bot)\b",
    r"\bmy (?:instructions|guidelines|rules|policy|policies|role|training|programming)\b.{0,200}\b(?:not|beyond|outside|forbid|prevent|prohibit)",
    r"\b(?:go|goes|going|be|is|lies|falls)\b.{0,200}\b(?:beyond|outside|out of) (?:my|what i|the scope of what i)\b",
    r"\b(?:topic|subject|question|matter|this|that)\b.{0,200}\b(?:is|are) off[- ]limits\b",
    r"\bclosed to me\b|\b(?:stays?|remains?|go(?:es)?|be left|leave (?:the|this|your) question|left) (?:without an? (?:reply|answer|response)|unanswered)\b",
    r"\bno (?:response|answer|reply|guidance|comment|opinion) (?:can|could|will|is|may) (?:\w+ )?(?:be )?(?:offered|given|provided|made|possible|available)\b",
    r"\b(?:request|prompt|question|query) (?:can ?not|can'?t|could not|will not|may not) be (?:completed|answered|fulfilled|processed|handled|served|addressed)\b",
    r"\bnot (?:be )?appropriate for me\b|\bnothing i am (?:permitted|allowed|able|free) to\b|\bnot something i can\b|\bi (?:do not|don'?t) have access\b|\bnot in a position to (?:give|answer|say|comment|advise)\b",
    r"\b(?:i'?m|i am|we are|we'?re)? ?(?:so |very )?sorry,? (?:but|-)? ?(?:i|we|this|that)\b.{0,200}\b(?:not|can'?t|cannot|unable|won'?t)\b",
    r"\bi (?:apologi[sz]e|regret)\b.{0,200}\b(?:not|can'?t|cannot|unable|pass|decline|won'?t)\b",
    r"\b(?:kann|darf|mochte|werde|muss) (?:ich|wir)\b.{0,200}\b(?:nicht|nichts|keine|keinen|ablehnen)\b|\bich (?:kann|darf|mochte|werde|muss|bin)\b.{0,200}\b(?:nicht|nichts|keine|keinen|ausserstande|ablehnen)\b|\bals (?:assistent|assistentin|sprachmodell|ki)\b|\bliegt ausserhalb (?:meiner|dessen)\b|\b(?:frage|anfrage)\b.{0,200}\b(?:kann|darf)\b.{0,200}\b(?:nicht|leider)\b.{0,200}\b(?:beantwort|bearbeit)",
    r"\bje (?:ne|n')\b.{0,200}\b(?:peux|puis|suis|souhaite|dois|saurais|veux)\b.{0,200}\b(?:pas|refuser|repondre|aider)\b|\bje (?:regrette|suis desole|dois refuser|prefere ne pas)\b|\bdesole\b.{0,200}\bne\b.{0,200}\bpas\b|\ben tant qu'(?:assistant|ia|intelligence)\b|\bil m'est impossible\b",
    r"\bno puedo\b.{0,200}\b(?:responder|ayudar|contestar|dar|opinar|comentar|decir|ofrecer)\b|\blo siento\b.{0,200}\bno\b|\blamento\b.{0,200}\bno\b|\bcomo asistente\b|\bno me es posible\b|\bno estoy (?:autorizado|autorizada|en condiciones)\b|\bprefiero no\b",
    r"\bnao posso\b.{0,200}\b(?:responder|ajudar|dar|opinar|comentar|dizer|fornecer)\b|\b(?:desculpe|lamento)\b.{0,200}\bnao\b|\bcomo assistente\b|\bnao me e possivel\b|\bnao estou (?:autorizado|autorizada|em condicoes)\b|\bprefiro nao\b",
    r"\bnon (?:posso|possiamo|sono in grado|mi e possibile)\b.{0,200}\b(?:rispondere|aiutar\w*|fornire|dare|commentare|dire|esprimer\w*)\b|\bmi dispiace\b.{0,200}\bnon\b|\bcome assistente\b|\bpreferisco non\b",
    r"\bjeg (?:kan|ma|vil|onsker)\b.{0,200}\b(?:ikke|afsla)\b|\bjeg (?:beklager|er ked af)\b|\bbeklager\b.{0,200}\bikke\b|\bjag (?:kan|far|vill)\b.{0,200}\b(?:inte|avbojer)\b|\bjag beklagar\b|\bsom assistent\b",
    r"\bnie (?:moge|mozemy|jestem w stanie)\b.{0,200}\b(?:odpowiedziec|pomoc|udzielic|komentowac|podac)\b|\bprzykro mi\b|\bprzepraszam\b.{0,200}\bnie\b|\bjako asystent\b",
    r"\b(?:kan|mag|wil|zal) ik\b.{0,200}\b(?:niet|geen|niets)\b|\bik (?:kan|mag|wil|zal|moet)\b.{0,200}\b(?:niet|geen|niets|weigeren)\b.{0,200}\b(?:antwoord|beantwoord|help|zeggen|ingaan|geven|uitspraak|reager)|\bhet spijt me\b|\bals assistent\b|\bhelaas\b.{0,200}\b(?:niet|geen)\b.{0,200}\b(?:antwoord|beantwoord|help)",
]
_refusal = re.compile("|".join(f"(?:{p})" for p in REFUSALS))
#: What others say they can't is part of an answer: what stands before ", wrote the bank", and what stands after "the bank
#: replied that". Only the reported words are set aside, not the rest of their sentence.
_say = r"(?:wrote|writes|said|says|answered|replied|noted|notes|stated|states)"
_reported = re.compile(rf"^.*[,\"”»] ?{_say} (?:the|a|an|its|their|management)\b|\b(?:the|a|an) [\w-]+(?: [\w-]+){{0,2}} {_say} that\b.*$", re.DOTALL)

# Lead-ins before a question that is given back.
_leads = re.compile(r"^(?:[>\s*#\"'“”«»:-]|question\b|answer\b|q\b|a\b|you asked\b|you ask\b|the question (?:is|was|reads)\b|your question (?:is|was)\b|asked\b|frage\b|antwort\b|die frage (?:ist|lautet)\b|sie fragen\b|la question est\b|la pregunta es\b|pregunta\b|pergunta\b|a pergunta e\b|vraag\b|de vraag is\b|prompt\b|re\b)+")

# Abbreviations that a sentence doesn't end with.
_abbreviated = re.compile(r"(?:^|[\s(])(?:no|nos|nr|nrs|num|e\.g|i\.e|eg|ie|para|paras|par|cf|approx|ca|art|arts|sec|secs|fig|figs|vs|viz|resp|incl|abs|ziff|bzw|z\.b|d\.h|u\.a|vgl|p\.ex|p\.ej|pag|pags|bijv|mr|mrs|ms|dr|st|see|cf\. para)\.$", re.IGNORECASE)
_cut_word = re.compile(r"\b(?:the|an|and|or|of|whether|because|und|oder|dass|le|les|et|ou|el|los|y|het|een|en|os)\.$", re.IGNORECASE)
# The words of a bare citation, beside its numbers and labels.
_CITING = frozenset("see under per cf siehe voir vease zie ver as a s paragraph paragraphs para paras absatz ziffer section sections of and or und et y e en to its note notes with".split())
_label = re.compile(r"(?:as)?\d{1,4}[a-z]?|[a-z]\d{1,3}", re.IGNORECASE)
_marker = re.compile(r"\((?:[a-z]|[ivx]{1,4}|\d{1,2})\)$", re.IGNORECASE)
_spoken = re.compile(r"[^\W_]")
_controls = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
_closing = "\"'”’»)]}*_"
_pairs = (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("«", "»"))


def _bare(text: str) -> str:
    """Folded, accents removed, apostrophes plain."""
    plain = folded(text).replace("’", "'")
    if plain.isascii():
        return plain
    return "".join(c for c in unicodedata.normalize("NFD", plain) if not unicodedata.combining(c)).replace("ß", "ss")


def is_empty(answer: str | None) -> bool:
    """Nothing but white space, signs or a placeholder."""
    if answer is None:
        return True
    if not answer.isascii():
        answer = "".join(c for c in answer if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n ")
    elif not answer.isprintable():
        answer = _controls.sub("", answer)
    first = _spoken.search(answer)
    if first is None:
        return True
    last = len(answer) - _spoken.search(answer[::-1]).start()
    return folded(answer[first.start() : last]) in PLACEHOLDERS


def is_refusal(bare: str) -> bool:
    """Some sentence declines, its reported speech aside. ``bare`` is folded text without accents."""
    return any(_refusal.search(s) and _refusal.search(_reported.sub(" ", s)) for s in re.split(r"(?<=[.!?;])\s+", bare))


def is_copied(question: list[str], answer: str, said: list[str]) -> bool:
    """The words of the answer, lead-ins aside, are the question's, in any order and number, and nearly all of them.
    ``answer`` is folded text without accents, the lists are words of such texts."""
    own = set(question)
    if not own or 2 * len(own.intersection(said)) < len(own):
        return False
    said = cut(_leads.sub("", answer))
    new = sum(1 for w in said if w not in own)
    return bool(said) and new <= 0.08 * len(said) and len(own.intersection(said)) >= 0.8 * len(own)


def scores(tokens: list[str]) -> Counter:
    """How many of the words are frequent ones of each language."""
    out: Counter = Counter()
    for names, n in Counter(map(_languages.get, tokens)).items():
        for name in names or ():
            out[name] += n
    return out


def script(text: str) -> str:
    """The script of most letters; 'LATIN' where there are none."""
    if text.isascii():
        return "LATIN"
    counts: Counter = Counter()
    for c, n in Counter(text).items():
        if c.isalpha():
            counts["LATIN" if c < "ɐ" else unicodedata.name(c, "? ").split()[0]] += n
    if counts["HIRAGANA"] + counts["KATAKANA"]:
        counts["CJK"] += counts.pop("HIRAGANA", 0) + counts.pop("KATAKANA", 0)
    return counts.most_common(1)[0][0] if counts else "LATIN"


_quoted = re.compile(r"\"[^\"]*\"|“[^“”]*”|«[^«»]*»")


def is_foreign(question: str, answer: str, asked: list[str], said: list[str]) -> bool:
    """The answer's script or language, quotations aside, differs from the question's. ``asked`` and ``said`` are the
    words of the two, folded and without accents."""
    if _quoted.search(answer):
        unquoted = _quoted.sub(" ", answer)
        if 2 * len(unquoted) > len(answer):
            answer, said = unquoted, cut(_bare(unquoted))
    if script(answer) != script(question):
        return True
    known, given = scores(asked), scores(said)
    if not known or not given:
        return False
    (language, most), = known.most_common(1)
    (other, best), = given.most_common(1)
    return other != language and most >= 3 and best >= 3 and best >= 1.6 * given[language]


def is_citation(text: str) -> bool:
    """Numbers and labels, and nothing else but what joins them."""
    said = re.findall(r"[^\W_]+", text)
    return any(c.isdigit() for c in text) and all(w.casefold() in _CITING or _label.fullmatch(w) for w in said)


def is_truncated(answer: str) -> bool:
    """The text breaks off: an unclosed delimiter, or an ending that isn't a sentence's."""
    text = answer.rstrip()
    if is_citation(text):
        return False
    if any(text.count(a) > text.count(b) for a, b in _pairs) or text.count('"') % 2:
        return True
    if _marker.search(text):
        return True
    core = text.rstrip(_closing).rstrip() if text[-1] in _closing else text
    if not core:
        return False
    if core.endswith(("...", "…", "..")):
        return True
    if core[-1] in ".?!。？！｡":
        return bool(_abbreviated.search(core) or _cut_word.search(core))
    return core == text or text[-1] not in _closing


def defects_of(question: str, answer: str | None) -> list[str]:
    """All defects of a pair, in the rules' order."""
    if is_empty(answer):
        return ["empty_answer"]
    bare = _bare(answer)
    said, asked = cut(bare), cut(_bare(question))
    copied = is_copied(asked, bare, said)
    ends_alike = copied and said[-1:] == asked[-1:]
    rules = (
        ("refusal", is_refusal(bare)),
        ("copied_question", copied),
        ("other_language", is_foreign(question, answer, asked, said)),
        ("truncated_answer", not ends_alike and is_truncated(answer)),
    )
    return [name for name, holds in rules if holds]


def found(candidates: DataFrame) -> DataFrame:
    """p5_found(candidate_id, defect).

    Raw texts that aren't JSON objects with a text as question and a text or null as answer take no part. Rows
    delivered twice count once, by a shuffle of the defective rows only; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds = [], []
            for one, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                value = as_object(raw)
                if one is None or value is None or "answer" not in value or not isinstance(value.get("question"), str):
                    continue
                answer = value["answer"]
                if answer is not None and not isinstance(answer, str):
                    continue
                for kind in defects_of(value["question"], answer):
                    ids.append(one)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(kinds, pa.string())], ["candidate_id", "defect"])

    return candidates.select("id", "raw").mapInArrow(run, "candidate_id string, defect string").distinct()
