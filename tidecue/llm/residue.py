"""Template residue, filler, error pages and script notices where speech should be.

Placeholders are found by one grammar per delimiter, outside code blocks and
inline code, and are discounted where their surroundings teach or quote a
template. A record that is nothing but residue is read unit by unit: each unit
must match one of the notice patterns, or the whole must be filler.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecue.session import spread

NAME = r"[A-Za-z_][\w.]*"

#: Borders against letters of alphabets that part words by spaces; ideographs may touch a placeholder.
NOT_AFTER, NOT_BEFORE = r"(?<![A-Za-z0-9_\u00c0-\u04ff])", r"(?:(?=[Ss][Tt][Rr](?:\.|a))|(?![A-Za-z0-9_\u00c0-\u04ff]))"

#: Grammars of placeholders by delimiter.
PLACEHOLDERS = {
    "braces_double": rf"\{{\{{\{{?\s*[#/&>^]?\s*{NAME}(?:\s*\|\s*\w[^{{}}\n]*)?\s*\}}?\}}\}}",
    "braces_percent": r"\{%-?\s*\w[^{}%\n]*%\}",
    "dollar": rf"\$\{{\s*{NAME}(?::-[^{{}}\n]*)?\s*\}}",
    "dollar_pair": rf"{NOT_AFTER}\$[A-Za-z_]\w+\${NOT_BEFORE}",
    "hash": rf"#\{{\s*{NAME}\s*\}}",
    "angle_percent": r"<%[=-]?\s*[^%<>\n]+%>",
    "percent_named": rf"%\(\w+\)[sdifrSD]{NOT_BEFORE}",
    "percent_bare": rf"{NOT_AFTER}(?<!%)(?<!\d )%[sdSD](?!%){NOT_BEFORE}",
    "percent_pair": rf"{NOT_AFTER}%[A-Z][A-Z0-9_]{{2,}}%{NOT_BEFORE}",
    "doubled_pair": r"(&&|@@|##|%%|\$\$|\^\^)\w[\w.-]*\1",
    "square_double": r"\[\[\s*\w[\w .-]*\]\]",
    "colon_pair": rf"{NOT_AFTER}(?<![:/]):[A-Za-z]+(?:_[A-Za-z]+)*:(?![:/]){NOT_BEFORE}",
    "underscore_pair": rf"{NOT_AFTER}__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__{NOT_BEFORE}",
    "brace_named": rf"{NOT_AFTER}(?<![{{$#%])\{{(?:[A-Za-z_]\w+|\d{{1,2}})?\}}(?!\}})",
    "angle_capitals": r"<[A-Z]{3,}(?:_[A-Z]+)*>",
    "square_insert": r"\[(?:INSERT|Insert|insert|YOUR|Your) [^\[\]\n]+\]|\[[^\[\]\n]+ (?:HERE|here)\]",
    "angle_here": r"(?i)<(?:tu|su|your|votre|ton|seu|sua|dein|ihr|il tuo|ваш)\s[^<>\n]+>|<[^<>\n/]{2,}\s(?:aquí|here|ici|aqui|hier|qui|здесь)>",
}
#: What must stand in a text for its grammar to find anything.
OPENERS = {
    "braces_double": "{{", "braces_percent": "{%", "dollar": "${", "dollar_pair": "$", "hash": "#{", "angle_percent": "<%", "percent_named": "%(", "percent_bare": "%", "percent_pair": "%",
    "square_double": "[[", "colon_pair": ":", "underscore_pair": "__", "brace_named": "{", "angle_capitals": "<", "square_insert": "[", "angle_here": "<",
}
_PLACEHOLDER = [(OPENERS.get(name, ""), re.compile(p)) for name, p in PLACEHOLDERS.items()]

#: What programs write for a missing value.
EMPTY_VALUES = ("undefined", "null", "(null)", "NaN", "None", "nil", "[object Object]", "N/A", "#REF!", "#N/A", "#VALUE!", "#NAME?")
_EMPTY = re.compile(rf"(?i:\[object Object\]|{NOT_AFTER}(?<![.-])(?:undefined|null|nan)(?!-){NOT_BEFORE})|{NOT_AFTER}(?<![.-])None(?!-){NOT_BEFORE}|{NOT_AFTER}N/A{NOT_BEFORE}|#(?:REF|VALUE)!|#N/A|#NAME\?")
#: Tokenizer markers, and markup in capitals, which is told from a placeholder by its closing tag.
_MARKER = re.compile(r"<(?:MASK|PAD|CLS|SEP|UNK|BOS|EOS)>")
_CAPITALS = re.compile(r"<[A-Z]+>")

_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`", re.S)
_TEACHES = re.compile(r"(?i)\b(?:placeholders?|templates?|syntax|variables?|tutorial|snippet|jinja|mustache|printf|plantillas?|marcador(?:es)?|variabl\w+|vorlagen?|platzhalter|modèles?|sintaxis|шаблон\w*)\b")
_CODE_CUES = re.compile(r"\b(?:def|function|return|import|const|var|let|print|echo|printf|class)\b|[;=]\s*$|=>|\(\)|</?code>|\$ ", re.M)
_QUOTES_LEFT, _QUOTES_RIGHT = "'\"“«‘`", "'\"”»’`"
_BLANK = re.compile(r"\n[^\S\n]*\n")
_BLANK_BEFORE = re.compile(r"(?s:.*)\n[^\S\n]*\n")
_SIGN = re.compile(r"[{%@\[<_#:$&^]")

_END = r"(?:[。！？।]|[.!?](?=\s|$)|(?=\n)|$)"
_TAIL = r"(?:\([^()\n]*\)|（[^（）\n]*）|[^\n(（])*?" + _END
_SCRIPTS = r"(?:java\s?script|자바스크립트|(?:ジャバ)?スクリプト|脚本|\bscript(?:s|ing)?\b|\bcookies?\b|skripten?\b|скрипт\w*)"
_SWITCH = (
    r"(?:turn(?:ed)? (?:it )?on|switch(?:ed)? (?:it )?o(?:n|ff)|enable|disabled|activat|needs?\b|requires?\b|blocks?\b|must|allow|activ[eo]|ative|habilit|desactivad|necesita|requiere|precisa|requer|"
    r"activez|exige|autoris|nécessite|désactiv|funktioniert nur|einschalten|aktivier|benötigt|abilita|attiva|richied|включит|требу|разреш|启用|开启|打开|需要|有効|必要|켜|필요|चालू|सक्षम|ज़रूर)"
)
#: Notices by family, in the languages of the profiles; a unit must match from its start.
NOTICES = {
    "status_line": r"http/\d(?:\.\d)?\s+[1-5]\d\d\b[^\n.]{0,40}" + _END,
    "status_words": r"[45]\d\d\s+(?:forbidden|not found|unauthorized|bad request|bad gateway|gateway time-?out|service unavailable|internal server error|too many requests|request time-?out|page not found|página no (?:disponible|encontrada)|página não encontrada|page (?:introuvable|non trouvée)|pagina non trovata|seite nicht gefunden|страница не найдена)" + _END,
    "numbered_error": r"(?:error|erro|errore|erreur|fehler|ошибка|错误|錯誤|エラー|오류|त्रुटि)\s*(?:code\s*)?#?[1-5]\d\d\s*[:：–—-]" + _TAIL,
    "not_loaded": r"(?:(?:we |sorry, we )?(?:could not|couldn.t|cannot|can.t|were unable to) (?:load|fetch|open|display|find)|(?:unable|failed) to (?:load|fetch|open)|no (?:hemos podido|se ha podido|se pudo|fue posible) (?:cargar|abrir|encontrar|mostrar)|não foi possível (?:carregar|abrir|encontrar)|impossible (?:de|d.) ?(?:charger|afficher|ouvrir)|impossibile (?:caricare|aprire)|(?:das |die |der )?\w+ konnten? nicht (?:geladen|gefunden|geöffnet) werden|не удалось (?:загрузить|открыть|найти)|无法(?:加载|打开|显示)|無法載入|字幕を読み込め|(?:ページ|字幕)を(?:表示|読み込)[^。\n]*ませんでした|자막을 불러오지|उपशीर्षक लोड)" + _TAIL,
    "try_again": r"(?:(?:please )?try again (?:in|later)|\d+分後にもう一度|もう一度お試し|\d+분 뒤에 다시|다시 시도|请(?:在)?\d*(?:分钟后)?重试|inténtelo (?:de nuevo )?en|tente (?:novamente )?em|réessayez dans|riprova tra|bitte in \d+ minuten erneut|повторите через|फिर कोशिश)" + _TAIL,
    "too_many": r"(?:too many requests|demasiadas peticiones|demasiadas solicitudes|muitos pedidos|trop de requêtes|troppe richieste|zu viele anfragen|слишком много запросов|请求过(?:多|于频繁)|リクエストが多すぎ|요청이 너무 많)" + _TAIL,
    "refused": r"(?:access (?:to [^\n.]{1,40} (?:was|is) (?:refused|denied|forbidden)|denied)|acceso denegado|acesso negado|accès (?:refusé|interdit)|accesso (?:negato|rifiutato)|zugriff (?:auf [^\n.]{1,40} )?verweigert|доступ [^\n.]{0,30}(?:запрещ|отклон)|拒绝访问|访问被拒绝|アクセスが拒否|접근이 거부)" + _TAIL,
    "session": r"(?:your session (?:ran out|has expired|expired|timed out)|(?:su|tu) sesión (?:ha )?(?:caducó|caducado|expiró|expirado)|sua sessão expirou|votre session a expiré|la (?:tua )?sessione è scaduta|ihre sitzung ist abgelaufen|(?:ваш\w* )?се(?:анс|ссия) \w*ист\w+)" + _TAIL,
    "sign_in": r"(?:sign in again|log in again|please (?:sign|log) in|vuelva a (?:entrar|iniciar)|inicie sesión|entre novamente|reconnectez-vous|accedi di nuovo|melden sie sich)" + _TAIL,
    "timed_out": r"(?:the connection to \S+ timed out|connection timed out|se agotó el tiempo de espera|tempo (?:limite )?esgotado|délai d.attente dépassé|zeitüberschreitung|tempo scaduto|превышено время)" + _TAIL,
    "server": r"(?:upstream server|unexpected (?:failure|error) while|traceback\b|internal server error|service (?:temporarily )?unavailable|exception in thread|fatal error\b|segmentation fault)" + _TAIL,
    "unavailable": r"(?:this (?:video|page|track|content) is (?:not available|unavailable)|el servicio no está disponible|serviço (?:temporariamente )?indisponível|servizio (?:momentaneamente |temporaneamente )?non disponibile|service (?:momentanément |temporairement )?indisponible|(?:der )?dienst ist (?:derzeit |zurzeit )?nicht (?:verfügbar|erreichbar)|сервис (?:временно )?недоступен|este (?:vídeo|contenido) no está disponible)" + _TAIL,
    "scripts": rf"(?=[^\n.!?。！？।]*?{_SCRIPTS})(?=[^\n.!?。！？।]*?{_SWITCH})" + _TAIL,
    "filler": r"(?:(?:sample|dummy|placeholder|example|filler) (?:text|caption|subtitle|content)\b|untitled segment\b|todo\s*:|your (?:text|subtitle|caption|title) (?:goes )?here|(?:insert|enter|type) (?:your )?(?:text|caption|subtitle) here|text goes here|texto de (?:ejemplo|exemplo|relleno|muestra|prueba)|aquí va el texto|aqui vai o texto|texte (?:provisoire|d.exemple|de remplissage)|testo (?:di esempio|segnaposto|provvisorio)|inserire (?:qui )?il testo|lege hier den text|(?:beispiel|blind|platzhalter|muster)text|пример текста|здесь (?:будет|должен быть) текст|此处(?:填写|输入|插入)|示例(?:文本|文字)|占位|ダミーテキスト|サンプルテキスト|ここにテキスト|예시 텍스트|샘플 텍스트|여기에 (?:텍스트|자막)|नमूना पाठ|यहाँ पाठ)" + _TAIL,
}
#: They are matched against lower-cased text; that on scripts is tried only where a text speaks of them.
_NOTICE = re.compile(r"\s*(?:" + "|".join(p for name, p in NOTICES.items() if name != "scripts") + ")")
_SCRIPT_NOTICE = re.compile(r"\s*(?:" + NOTICES["scripts"] + ")")
_STOP = re.compile(r"[\n.!?。！？।]")
_SCRIPT_HINTS = ("script", "cookie", "脚本", "스크립트", "スクリプト", "skript", "скрипт")

#: Words for the lack of a text in the languages of the profiles: with what they deny, and alone between marks.
_LACK = r"(?:no|without|sin|sem|sans|ohne|kein(?:en?)?|senza|nessun|без|нет)\s+(?:text|captions?|subtitles?|content|transcript|texto|contenido|subtítulos?|conteúdo|legendas?|texte|contenu|inhalt|testo|contenuto|текста|содержания)"
_LACKING = r"(?:empty|blank|missing|vacío|vacía|vazio|vazia|vide|leer|vuoto|vuota|пусто|空|无内容|無内容|无文本|テキストなし|내용 없음|비어 있음|खाली)"
#: A note that there is no text: the denial in brackets, dashes or alone, one word in brackets or dashes, or the slashed short form.
_NO_TEXT = re.compile(rf"(?i)[-–—=*<(\[{{\s]*{_LACK}[-–—=*>)\]}}\s.]*|[-–—=*<(\[{{]+\s*{_LACKING}\s*[-–—=*>)\]}}]+|[ns]/[acd]\.?")

#: The words of the printers' filler text, and typed filler.
FILLER_WORDS = frozenset(
    (
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
        "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat "
        "non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    ).split()
)
TYPED_FILLER = frozenset("asdf asdfg asdfgh qwerty qwertz xxx xxxx xxxxx tbd tba todo text texto texte testo blah bla foo bar baz test lorem n/a zzz".split())

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_TAGS = re.compile(r"<[^<>]+>")
_ONLY_STRUCTURE = re.compile(r"^(?:\ufeff?WEBVTT.*|\s*\d+\s*|.*-->.*|#+ \d\d:\d\d:\d\d.*)$", re.M)
_HEADING = re.compile(r"^#+ .*$", re.M)
_WORD = re.compile(r"[^\W_]+(?:/[^\W_]+)?")


class _Counts(dict):
    """Token between blanks to (its words, how many of them are printers' filler, the different ones)."""

    def __missing__(self, token: str) -> tuple[int, int, frozenset[str]]:
        if len(self) > 200_000:
            self.clear()
        words = _WORD.findall(token.lower())
        out = self[token] = (len(words), sum(map(FILLER_WORDS.__contains__, words)), frozenset(words))
        return out


_COUNTS = _Counts()


def _is_filler(text: str) -> bool:
    """Whether four fifths of a text's words are printers' filler, or all are the same typed filler.

    A text is read no further once filler alone, of at least two letters and a
    gap a word, could not make up for the words already read.
    """
    known = total = 0
    left = len(text)
    different: frozenset[str] = frozenset()
    for token in text.split():
        n, filler, words = _COUNTS[token]
        known += filler
        total += n
        left -= len(token)
        if len(different) < 2:
            different |= words
        elif 4 * (total - known) > known + left // 3 + 1:
            return False
    if known >= 2 and known >= 0.8 * total:
        return True
    return total >= 2 and len(different) == 1 and different <= TYPED_FILLER


def is_only_residue(text: str) -> bool:
    """Whether a text is nothing but a notice, filler or an empty value."""
    body = text.strip()
    if body in EMPTY_VALUES or body.rstrip(".!") in EMPTY_VALUES or _NO_TEXT.fullmatch(body):
        return True
    if body[:1] == "{":
        try:
            found = json.loads(body)
        except ValueError:
            found = None
        if isinstance(found, dict) and found.keys() & {"status", "error", "message", "code", "detail"}:
            return True
    if body[:1] == "<" and "<html" in body.lower():
        body = _COMMENT.sub("\n", body)
        return _only_units(_TAGS.sub("\n", body)) or _is_filler(_TAGS.sub(" ", body))
    if _only_units(body) or _is_filler(body):
        return True
    if "-->" in body or body[:1] in "#\ufeffW":
        plain = _ONLY_STRUCTURE.sub("", body)
        if plain != body or "#" in body[:1]:
            bare = _HEADING.sub("", plain).strip()
            return bool(bare) and (bare in EMPTY_VALUES or _only_units(bare) or _is_filler(bare))
    return False


def _only_units(text: str) -> bool:
    """Whether notices follow one another from the start to the end; spans of filler may stand between them."""
    at, found = 0, False
    text = text.strip().lower()
    while at < len(text):
        m = _NOTICE.match(text, at)
        if m is None:
            sentence = text[at : stop.start() if (stop := _STOP.search(text, at)) else len(text)]
            if any(h in sentence for h in _SCRIPT_HINTS):
                m = _SCRIPT_NOTICE.match(text, at)
        if m and m.end() > at and m.group().strip():
            at, found = m.end(), True
            continue
        if text[at].isspace() or text[at] in ".,;:!?\"'":
            at += 1
            continue
        stop = text.find("\n", at)
        if (found or stop >= 0) and _is_filler(line := text[at : stop if stop >= 0 else len(text)]):
            at, found = at + len(line), True
            continue
        return False
    return found


def _is_markup(found: str, text: str) -> bool:
    return bool(_MARKER.match(found) or _CAPITALS.fullmatch(found) and "</" + found[1:].lower() in text.lower())


#: Share of code cues among the words of a paragraph from which on it is code, and their number at least.
CODE_DENSITY, CODE_CUES = 0.15, 2


def _teaching(text: str, start: int, end: int) -> bool:
    """Whether a placeholder is quoted in a paragraph about templates or stands in dense code."""
    before, after = text[start - 1 : start], text[end : end + 1]
    first, last = _BLANK_BEFORE.search(text, 0, start), _BLANK.search(text, end)
    paragraph = text[first.end() if first else 0 : start] + " " + text[end : last.start() if last else len(text)]
    quoted = before in _QUOTES_LEFT and after in _QUOTES_RIGHT and before and after
    if (quoted or "<code>" in paragraph) and _TEACHES.search(paragraph):
        return True
    cues = len(_CODE_CUES.findall(paragraph))
    return cues >= CODE_CUES and cues >= CODE_DENSITY * len(_WORD.findall(paragraph))


def has_placeholder(text: str) -> bool:
    """Whether a placeholder, or an empty program value in its place, stands in a text."""
    if not _SIGN.search(text):
        low = text.lower()
        if not any(word in low for word in ("null", "undefined", "none", "nan", "n/a")):
            return False
    if "`" in text or "~~~" in text:
        text = _CODE.sub(" ", text)
    for opener, pattern in _PLACEHOLDER:
        for m in pattern.finditer(text) if opener in text else ():
            if not _is_markup(m.group(), text) and not _teaching(text, m.start(), m.end()):
                return True
    for m in _EMPTY.finditer(text):
        before = text[: m.start()].rstrip().rsplit(None, 1)[-1:] if m.start() else []
        last = before[0].lower() if before else ""
        value = m.group()
        if value == "None" and (not last or last[-1] in ".!?") and text[m.end() : m.end() + 4] == " of ":
            continue
        if value.lower() == "undefined" and last in ("is", "an", "are", "was", "be", "remains", "left"):
            continue
        if value.lower() == "null" and re.match(r"\s+(?:uhr|grad|komma|prozent|and void)\b", text[m.end() :], re.I):
            continue
        if not _teaching(text, m.start(), m.end()):
            return True
    return False


def residue_kind(text: str | None) -> str | None:
    """'only' for a text that is nothing but residue, 'part' for real text with a placeholder, else None."""
    if not text or text.isspace():
        return None
    if is_only_residue(text):
        return "only"
    return "part" if has_placeholder(text) else None


def find_residue(df: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """Columns (row_id, kind) of the records with residue; kind is 'only' or 'part'.

    A row of df gives at most one row; repeated rows repeat. Null and blank
    texts, sound notes, markup and tokenizer markers give none, nor do empty
    tables. A null id stays null. Other columns are ignored. No shuffle.
    """
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(f"`{id_column}`").alias("row_id"), F.col(f"`{text_column}`").alias("text")).where("length(trim(text)) > 0")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [residue_kind(t) for t in batch.column(1).to_pylist()]
            at = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([kinds[i] for i in at], pa.string())], names=["row_id", "kind"])

    return spread(rows).mapInArrow(find, f"row_id {kind}, kind string")
