"""French stop words used when a CV is cleaned for text search.

Our own list: the public Snowball French stop-word list. The reference ships a longer list of its own;
the rule that uses it (drop listed words after splitting) is the same.
"""

# The Snowball French stop-word list, in its published order.
FRENCH_STOPWORDS: tuple[str, ...] = tuple(
    """
    au aux avec ce ces dans de des du elle en et eux il ils je la le les leur lui ma mais me même mes
    moi mon ne nos notre nous on ou par pas pour qu que qui sa se ses son sur ta te tes toi ton tu un
    une vos votre vous c d j l à m n s t y été étée étées étés étant étante étants étantes suis es est
    sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais
    était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses
    fût fussions fussiez fussent ayant ayante ayantes ayants eu eue eues eus ai as avons avez ont aurai
    auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez
    avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez
    eussent
    """.split()
)


def load_stopwords(path: str | None = None, lang: str = "fr") -> tuple[str, ...]:
    """Stop words from a JSON file ``{"fr": [...]}``; a missing or unreadable file gives no stop words.

    Without a path the built-in list is returned.
    """
    if path is None:
        return FRENCH_STOPWORDS
    import json

    try:
        with open(path, encoding="utf-8") as fh:
            return tuple(json.load(fh).get(lang, []))
    except (OSError, ValueError):
        return ()
