"""What a person's message says about itself: rules of a detector, scripted checks, tags, terms.

Null texts are empty: no rule fires, no tag and no term is found.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed rules of the reference, in its order: name, kind, pattern. The first that fires names the kind. All but
# ``initial_no`` stand between characters that are no letters, digits or underscores.
USER_RULES = (
    ("told_you", "correction", r"te dije que|ya te dije|como te dije|te lo dije|i told you|as i said|eso rompe|eso está mal|eso esta mal|that'?s wrong|that is wrong"),
    ("initial_no", "correction", r"^\s*no[.,!]\s+\S"),
    ("remember", "invariant", r"recuerda|record[aá]|acu[eé]rdate|no olvides|ten en cuenta|ten[eé] en cuenta|remember|keep in mind|don'?t forget"),
    ("from_now_on", "invariant", r"de ahora en adelante|a partir de ahora|desde ahora|en adelante|from now on|going forward|por defecto|by default"),
    ("never_always", "invariant", r"nunca|jam[aá]s|siempre|never|always"),
    ("all_we_do", "invariant", r"tod[oa]s? (?:l[oa]s )?\w+ (?:l[oa]s )?(?:hacemos|usamos|corremos|van|corren|ejecutamos)"),
    ("must_general", "invariant", r"debe(?:n)? ser|no debe(?:n|s)?|no deber[ií]a|must not|must always|should never|has to be"),
    ("prefer", "preference", r"prefiero|preferir[ií]a|me gusta(?:r[ií]a)? que|no me gusta|no quiero que|i prefer|i'd rather|i would rather|i don'?t want you to|i don'?t like"),
    ("record_request", "preference", r"guarda(?:lo)?|guard[aá]|registra(?:lo)?|registr[aá]|anota(?:lo)?|deja(?:lo)? registrado|dej[aá] registrado|save (?:this|that|it)|store (?:this|that)|note (?:this|that) down|en tus (?:skills|memorias?)|en (?:tu|la) memoria|in your memory"),
    ("scope", "decision", r"fuera del scope|fuera de(?:l)? alcance|out of scope"),
    ("we_have", "fact", r"ya tenemos|tenemos otr[oa]|we have another|we already have"),
)
# Fixed markers of what is never stored unattended: name, pattern between characters that are no letters, digits or underscores.
SENSITIVE_FLAGS = (
    ("identity", r"(?:my|mi|mis) (?:name|surname|email|e-mail|phone|address|birthday|birth date|age|passport|nombre|apellido|correo|tel[eé]fono|celular|direcci[oó]n|cumplea[nñ]os|edad|pasaporte|rut|dni)"),
    ("money", r"(?:usd|eur|clp|\$\s?\d|dinero|money|precio|price|pago|payment|invertir|invest\w*|inversi[oó]n|sueldo|salary|salario|tarjeta|card|banco|bank|cr[eé]dito|credit)"),
    ("security", r"(?:password|contrase[nñ]a|clave|token|api[ _-]?key|secret|secreto|ssh|credential\w*|credencial\w*|firewall|2fa|mfa|security|seguridad|permiso\w*|permission\w*|sudo|root)"),
)
# Fixed topics that are never acted on unattended: name, patterns anywhere, words between characters that are no letters, digits or underscores.
SENSITIVE_TOPICS = (
    ("identity", (r"[\w.+-]+@[\w-]+\.[\w.]+", r"\+\d{1,3}[\s.-]?\(?\d{1,4}\)?(?:[\s.-]?\d{2,4}){2,4}"),
     r"\d{1,2}\.?\d{3}\.?\d{3}-[\dkK]|passport|pasaporte|ssn|social security|date of birth|fecha de nacimiento|birthday|cumpleaños|home address|direcci[oó]n|domicilio|rut|dni|c[eé]dula|phone number|tel[eé]fono|celular|whatsapp"),
    ("money", (r"[$€£]\s?\d",),
     r"\d[\d.,]*\s?(?:usd|clp|eur|uf|btc|eth)|bank|banco|bancari\w*|iban|swift|credit card|tarjeta|invoice|factura\w*|billing|payment|pago|pagos|salary|sueldo|salario|loan|pr[eé]stamo|deuda|debt|mortgage|hipoteca|"
     r"tax|impuesto\w*|wallet|crypto\w*|bitcoin|transferencia\w*|budget|presupuesto|price|precio|cost|costo|subscription|suscripci[oó]n|stripe|paypal"),
    ("security", (),
     r"security|seguridad|password|passwords|contraseña\w*|passphrase|credential\w*|credencial\w*|secret|secrets|secreto\w*|api[ _-]?keys?|access[ _-]?tokens?|auth(?:entication|enticated|orization|orized)?|oauth|2fa|mfa|totp|otp|"
     r"ssh|gpg|pgp|private key|llave privada|firewall|vpn|cve-\d+|vulnerab\w*|exploit\w*|malware|phishing|sudo|root access|permission\w*|permiso\w*|encrypt\w*|cifrad\w*|certificate|certificado|keyring|vault token"),
)
# Fixed words that ask for an exact reply, and limits of a scripted check.
EXACT_REPLY = r"(?iu)\b(?:exactly|exactamente|verbatim|literally|literalmente)\b"
ECHO_PROMPT, ECHO_ANSWER = 500, 80
# Fixed patterns of what the detector does not read: code blocks, quoted lines, code, links.
UNREAD = (r"```[\s\S]*?```", r"(?m)^\s*>.*$", r"`[^`\n]*`", r"\b(?:https?|file)://\S+|@url:\S+")
# Fixed patterns of a hash tag and of front matter.
HASH_TAG = r"(?U)(?<!\w)#([A-Za-z0-9_/-]+)"
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n?"


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _stripped(value: Column, chars: str = r"\s") -> Column:
    """Without any of a class of characters at either end."""
    return F.regexp_replace(value, rf"^[{chars}]+|[{chars}]+$", "")


def readable(text: Column) -> Column:
    """The text with a space for each code block, quoted line, piece of code and link."""
    return reduce(lambda t, p: F.regexp_replace(t, f"(?dU){p}", " "), UNREAD, _text(text))


def rules_fired(text: Column) -> Column:
    """Struct of ``kind`` (that of the first rule that fires, else null) and ``rules`` (names of all that do)."""
    read = readable(text)

    def fires(name: str, pattern: str) -> Column:
        return read.rlike(f"(?iuU){pattern}" if name == "initial_no" else rf"(?iuU)(?<!\w)(?:{pattern})(?!\w)")

    hits = F.array_compact(F.array(*[F.when(fires(name, p), F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"))) for name, kind, p in USER_RULES]))
    return F.struct(F.get(hits, F.lit(0))["kind"].alias("kind"), F.transform(hits, lambda h: h["name"]).alias("rules"))


def turn_sides(text: Column) -> Column:
    """Struct of ``user`` and ``assistant`` of a stored turn; any other text is the user's."""
    text, sep = _text(text), "\nAssistant: "
    both = text.startswith("User: ") & F.contains(text, F.lit(sep))
    user = F.when(both, F.substr(F.substring_index(text, sep, 1), F.lit(len("User: ") + 1))).otherwise(text)
    return F.struct(user.alias("user"), F.when(both, F.substr(text, F.locate(sep, text) + len(sep))).otherwise("").alias("assistant"))


def echo_probe(user: Column, assistant: Column) -> Column:
    """Whether a turn is a scripted check: a short prompt asks for an exact reply, the answer is one short line of it."""
    prompt, answer = _stripped(_text(user)), _stripped(_text(assistant))
    core = _stripped(_stripped(_stripped(F.regexp_replace(answer, r"[.!]+$", "")), "`'\""))
    asked = (prompt != "") & (F.length(prompt) <= ECHO_PROMPT) & prompt.rlike(EXACT_REPLY)
    given = (answer != "") & ~F.contains(answer, F.lit("\n")) & (F.length(answer) <= ECHO_ANSWER)
    return asked & given & (core != "") & F.contains(F.lower(prompt), F.lower(core))


def turn_noise(text: Column, known: Column, source: Column, one_shot: tuple[str, ...]) -> Column:
    """Why a turn is left out: its session is of a one-shot source; or its session is not known and it is a
    scripted check. Else empty. The host's own rows are not judged here."""
    sides = turn_sides(text)
    lone = F.lower(F.trim(_text(source))).isin(*one_shot)
    return F.when(known & lone, "one_shot_session").when(~known & echo_probe(sides["user"], sides["assistant"]), "echo_probe").otherwise("")


def tags(text: Column) -> Column:
    """Sorted distinct tags: ``#word`` anywhere, and the ``tags:`` of front matter, in a line, a bracketed list or lines with dashes."""
    text = _text(text)
    none = F.array().cast("array<string>")

    def bare(item: Column) -> Column:
        return F.regexp_replace(_stripped(_stripped(item), "'\""), r"^#+", "")

    def step(state: Column, raw: Column) -> Column:
        line = _stripped(raw)
        rest = _stripped(F.regexp_replace(line, r"^tags:", ""))
        heads, dashed = line.startswith("tags:"), state["listed"] & line.startswith("-")
        inside = F.transform(F.split(_stripped(rest, r"\[\]"), ","), bare)
        new = F.when(heads & rest.startswith("[") & rest.endswith("]"), inside).when(heads, F.array(bare(rest))).when(dashed, F.array(bare(F.substr(line, F.lit(2))))).otherwise(none)
        listed = F.when(line == "", state["listed"]).when(heads, True).when(dashed | raw.rlike(r"^[ \t-]"), state["listed"]).otherwise(False)
        return F.struct(listed.alias("listed"), F.concat(state["found"], new).alias("found"))

    lines = F.split(F.regexp_extract(text, FRONT_MATTER, 1), r"\r\n|\n|\r")
    listed = F.aggregate(lines, F.struct(F.lit(False).alias("listed"), none.alias("found")), step)["found"]
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.regexp_extract_all(text, F.lit(HASH_TAG), 1), listed), lambda t: t != "")))


def terms_present(terms: list[str], *fields: Column) -> Column:
    """Those of the terms, in order, that some field holds, whatever the case; empty terms are never found."""
    lowered = [F.lower(_text(f)) for f in fields]
    hits = [F.when(reduce(lambda a, b: a | b, [F.contains(f, F.lit(t.lower())) for f in lowered]), F.lit(t)) for t in terms if t]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def sensitive_flags(text: Column) -> Column:
    """Names of the markers that a text has: identity, money, security."""
    return F.array_compact(F.array(*[F.when(_text(text).rlike(rf"(?iuU)(?<!\w)(?:{p})(?!\w)"), F.lit(name)) for name, p in SENSITIVE_FLAGS]))


def sensitive_topics(text: Column) -> Column:
    """Names of the topics that a text touches; broader than the flags, for what is already stored."""
    text = _text(text)

    def touches(free: tuple[str, ...], words: str) -> Column:
        return text.rlike("|".join([*free, rf"\b(?:{words})\b"]).join(("(?iuU)(?:", ")")))

    return F.array_compact(F.array(*[F.when(touches(free, words), F.lit(name)) for name, free, words in SENSITIVE_TOPICS]))
