"""Word lists, patterns and constants of the session analytics."""

import re

# Substrings that mark subscription and raid notices.
SUB_NOTICES = (
    "subscribed with prime", "subscribed at tier", "gifted a tier", "gifted a sub", "is gifting", "gifted to",
    "they've subscribed for", "currently on a", "month streak", "gifted subs", "gifting subs", "raided the channel", "raid",
)
# The narrower list of the download step.
SUB_NOTICES_NARROW = ("subscribed with prime", "gifted a tier", "gifted a sub", "is gifting", "gifted to")

# Patterns of gift notices, system notices and links.
SPAM_PATTERNS = (
    r"gifted\s+(?:a\s+)?(?:tier\s+)?(?:sub(?:scription)?)", r"is\s+gifting", r"gifted\s+to", r"subscribed\s+(?:with\s+)?prime",
    r"prime\s+subscription", r"tier\s+\d+\s+subscription", r"gift\s+subscription", r"gifted\s+\d+\s+subs", r"gifting\s+\d+\s+subs",
    r"raided\s+the\s+channel", r"hosted\s+the\s+channel", r"followed\s+the\s+channel", r"cheered\s+\d+", r"bits\s+donation",
    r"channel\s+point\s+redemption",
    r"https?://", r"www\.", r"\.com/", r"\.org/", r"\.net/", r"\.io/", r"youtu\.be/", r"open\.spotify\.com", r"twitch\.tv/",
    r"discord\.gg/", r"bit\.ly/", r"tinyurl\.com/",
)

# Domain terms looked for as keywords.
DOMAIN_TERMS = (
    "boss fight", "epic moment", "funny moment", "reaction", "chat", "streamer", "viewer", "subscriber", "donation", "follow",
    "gameplay", "build", "craft", "mine", "explore", "battle", "victory", "defeat", "achievement", "quest", "mission",
    "music video", "song release", "just chatting", "streaming", "welcome", "thank you", "story time", "gym", "vocal artist",
)

# Words without weight in token similarity, and suffixes that are stripped.
STOP_WORDS = ("the", "a", "an", "and", "or", "to", "of", "for", "in")
SUFFIXES = ("ing", "ed", "es", "s")

# How strongly a reaction token suggests that a round has ended.
END_STRONG = (
    "gg", "ggs", "gg no re", "good game", "ggez", "ggwp", "go next", "gonext", "next round", "next game", "new game",
    "queue up", "queue again", "requeue", "match found", "match over", "round over", "game over", "game ended",
    "new run", "good run", "goodrun", "total wipeout", "back to lobby", "return to lobby", "back to menu",
    "you are the champion", "chicken dinner", "you died", "wasted", "mission failed", "terrorists win",
    "counter terrorists win", "final killcam", "play of the game", "we won", "we lost", "victory", "victory royale", "defeat",
    "finish", "finished", "end", "its over", "it's over", "die", "death",
)
END_MEDIUM = (
    "ez", "ezclap", "easyclap", "pepeclap", "peepoclap", "goodbye", "bye", "o7", "07", "ff", "ff15", "ready up", "q up",
    "wp", "well played", "nt", "nice try", "rip", "press f", "f in chat", "on to the next", "onto the next",
)
END_WEAK = (
    "lets go", "lesgo", "letsgoo", "yaaa", "w", "win", "pog", "again", "holy", "awesome", "lmao", "lmfao", "lol", "xd", "no",
    "omg", "oh noo", "oh no", "noooo", "noway", "aintnoway", "thats crazy", "cinema", "kekw", "kek", "sadge", "monka",
    "pepelaugh", "pausechamp", "goat", "greatest of all time", "cooked", "lul",
)

#: Characters that may not touch a reaction: words; words and links; words, links and hyphens.
WORD, LINK, DASH = "A-Za-z0-9_", "A-Za-z0-9_./:@", "A-Za-z0-9_./:@-"

# Reaction tokens, the characters that may not touch them, and their forms.
REACTIONS = {
    "gg": (LINK, r"[gG]{2,}"), "ggs": (LINK, r"[gG]{2,}[sS]+"), "good game": (WORD, r"[gG]ood\s*[gG]ame[sS]*"),
    "gg no re": (WORD, r"[gG]{2,}\s*[nN]o\s*[rR]e"), "ggez": (LINK, r"[gG]{2,}[eE][zZ]+"), "ez": (LINK, r"[eE][zZ]+"),
    "o7": (LINK, r"[oO]7"), "07": (DASH, r"07"), "ff": (LINK, r"[fF]{2,}"), "ff15": (LINK, r"[fF]{2,}\s*@?\s*1[05]"),
    "easyclap": (WORD, r"[eE]asy\s*[cC]lap"), "ezclap": (WORD, r"[eE][zZ]+\s*[cC]lap"), "pepeclap": (WORD, r"[pP]epe\s*[cC]lap"),
    "peepoclap": (WORD, r"[pP]eepo\s*[cC]lap"), "gonext": (WORD, r"[gG]o[nN]ext"), "go next": (WORD, r"[gG]o\s*[nN]ext"),
    "next game": (WORD, r"[nN]ext\s*[gG]ame"), "new game": (WORD, r"[nN]ew\s*[gG]ame"), "ready up": (WORD, r"[rR]eady\s*[uU]p"),
    "q up": (WORD, r"[qQ]\s*[uU]p"), "lets go": (WORD, r"(?:[lL]ets+|[lL]et['']s+)\s*[gG]o+"), "lesgo": (WORD, r"[lL]esgo+"),
    "letsgoo": (WORD, r"[lL]etsgoo+"), "yaaa": (WORD, r"[yY]aaa+"), "win": (DASH, r"[wW]in"), "victory": (DASH, r"[vV]ictory"),
    "victory royale": (WORD, r"[vV]ictory\s*[rR]oyale"), "defeat": (DASH, r"[dD]efeat"),
    "pog": (DASH, r"[pP]og+(?:gers|champ|u)?"), "end": (DASH, r"[eE]nd"), "next round": (WORD, r"[nN]ext\s*[rR]ound"),
    "round over": (WORD, r"[rR]ound\s*(?:[oO]ver|[eE]nd(?:ed)?)"), "match over": (WORD, r"[mM]atch\s*(?:[oO]ver|[eE]nd(?:ed)?)"),
    "game over": (WORD, r"[gG]ame\s*[oO]ver"), "game ended": (DASH, r"[gG]ame\s*[eE]nded"), "again": (DASH, r"[aA]gain"),
    "queue up": (WORD, r"[qQ]ueue\s*[uU]p"), "queue again": (WORD, r"[qQ]ueue\s*[aA]gain"),
    "requeue": (WORD, r"[rR]e-?queue(?:ing)?"), "match found": (WORD, r"[mM]atch\s*[fF]ound"), "new run": (WORD, r"[nN]ew\s*[rR]un"),
    "goodrun": ("A-Za-z0-9_./@-", r"[gG]ood[rR]un"), "good run": (WORD, r"[gG]ood\s*[rR]un"),
    "total wipeout": (WORD, r"[tT]otal\s*[wW]ipeout"), "rip": (DASH, r"[rR][iI][pP]"), "press f": (WORD, r"[pP]ress\s*[fF]"),
    "f in chat": (WORD, r"[fF](?:'s)?\s*in\s*(?:the\s*)?[cC]hat"), "ggwp": (LINK, r"[gG]{2,}[wW][pP]"), "wp": (LINK, r"[wW][pP]"),
    "well played": (WORD, r"[wW]ell\s*[pP]layed"), "nt": (LINK, r"[nN][tT]"), "nice try": (WORD, r"[nN]ice\s*[tT]ry"),
    "ope": (DASH, r"[oO]pe"), "finish": (DASH, r"[fF]inish"), "finished": (DASH, r"[fF]inished"), "we won": (WORD, r"[wW]e\s*[wW]on"),
    "we lost": (WORD, r"[wW]e\s*[lL]ost"), "back to lobby": (WORD, r"[bB]ack\s*to\s*[lL]obby"),
    "return to lobby": (WORD, r"[rR]eturn\s*to\s*[lL]obby"),
    "back to menu": (WORD, r"(?:[bB]ack|[rR]eturn)\s*to\s*(?:main\s*)?[mM]enu"),
    "you are the champion": (WORD, r"[yY]ou\s*are\s*the\s*[cC]hampion"), "chicken dinner": (WORD, r"[cC]hicken\s*[dD]inner"),
    "you died": (WORD, r"[yY]ou\s*[dD]ied"), "wasted": (DASH, r"[wW]asted"), "mission failed": (WORD, r"[mM]ission\s*[fF]ailed"),
    "on to the next": (WORD, r"[oO]n\s*to\s*the\s*[nN]ext"), "onto the next": (WORD, r"[oO]nto\s*the\s*[nN]ext"),
    "terrorists win": (WORD, r"[tT]errorists\s*[wW]in"),
    "counter terrorists win": (WORD, r"[cC]ounter[-\s]*[tT]errorists\s*[wW]in"),
    "final killcam": (WORD, r"[fF]inal\s*[kK]ill\s*[cC]am"), "play of the game": (WORD, r"[pP]lay\s*of\s*the\s*[gG]ame"),
    "lmao": (LINK, r"[lL][mM][aA][oO]+"), "lmfao": (LINK, r"[lL][mM][fF][aA][oO]+"), "lol": (LINK, r"[lL][oO][lL]+"),
    "xd": (LINK, r"[xX][dD]+"), "no": (LINK, r"[nN][oO]+"), "om": (LINK, r"[oO][mM]"), "kekw": (LINK, r"[kK][eE][kK][wW]"),
    "kek": (LINK, r"[kK][eE][kK]"), "w": (DASH, r"[wW]"), "holy": (DASH, r"[hH]oly"), "awesome": (DASH, r"[aA]wesome"),
    "omg": (DASH, r"[oO][mM][gG]+"), "oh noo": (WORD, r"[oO]h\s*[nN]oo+"), "oh no": (WORD, r"[oO]h\s*[nN]o+"),
    "noooo": (DASH, r"[nN]oooo+"), "noway": (DASH, r"[nN][oO][wW][aA][yY]+"), "aintnoway": (DASH, r"[aA]int[nN]ow[aA]+[yY]+"),
    "thats crazy": (WORD, r"[tT]hats?\s*[cC]razy+"), "cinema": (DASH, r"[cC]inema"), "sadge": (LINK, r"[sS]adge"),
    "monka": (LINK, r"[mM]onka"), "pepelaugh": (LINK, r"[pP]epe[lL]augh"), "pausechamp": (LINK, r"[pP]ause[cC]hamp"),
    "goat": (DASH, r"[gG]\.?[oO]\.?[aA]\.?[tT]\.?"), "greatest of all time": (WORD, r"[gG]reatest\s*of\s*all\s*[tT]ime"),
    "die": (DASH, r"[dD]ie(?:d|s|ing)?"), "death": (DASH, r"[dD]eath"), "its over": (WORD, r"[iI]t['']?s\s*[oO]ver"),
    "it's over": (WORD, r"[iI]t['']?s\s*[oO]ver"), "cooked": (DASH, r"[cC]ooked"), "lg": (DASH, r"[lL][gG]"),
    "last game": (WORD, r"[lL]ast\s*[gG]ame[sS]?"), "last round": (WORD, r"[lL]ast\s*[rR]ound[sS]?"), "lul": (LINK, r"[lL][uU][lL]+"),
}

#: What every match of a form holds in lower case, where it is not the first word of the token.
REACTION_PARTS = {
    "ggs": "gg", "ggez": "gg", "ggwp": "gg", "ff15": "ff", "easyclap": "easy", "ezclap": "ez", "pepeclap": "pepe", "peepoclap": "peepo",
    "lets go": "let", "requeue": "queue", "f in chat": "chat", "back to menu": "menu", "aintnoway": "aint", "thats crazy": "that",
    "pepelaugh": "pepe", "pausechamp": "pause", "goat": "g", "its over": "it", "it's over": "it",
}


def reaction_pattern(name: str) -> str:
    """The pattern of a reaction: its form, not touched by the characters of its guard."""
    guard, form = REACTIONS[name]
    first = re.match(r"\[[a-zA-Z]+\]|\w", form)  # seen first, so that most places fail before the look-behind
    return rf"{f'(?={first[0]})' if first else ''}(?<![{guard}]){form}(?![{guard}])"
