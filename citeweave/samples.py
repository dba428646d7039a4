"""Small made-up inputs of the registered queries, for both the queries and their SQL."""

from __future__ import annotations

#: Eight searches, two a language of the documents; the words are frequent ones of the sample texts.
SEARCHES = [(0, "en", "the erst", "of that and"), (1, "en", "tion thonti in", "ingly was"), (2, "fr", "les eaux", "de la mente"), (3, "fr", "une elle", "pour avec"), (4, "de", "und nicht", "der die ung"), (5, "de", "von sich", "ein mit"), (6, "es", "que para", "los una"), (7, "es", "por esa", "del como")]
TYPES_USED = ("web", "news")

#: Messages of failed probes.
ERRORS = ("getaddrinfo ENOTFOUND x", "Temporary failure in name resolution", "nodename nor servname provided", "connect ECONNREFUSED 1.2.3.4", "Connection refused by host", "SSL handshake failed", "certificate has expired", "socket timed out", "uncertain state")
#: Statuses of probes by kind; kinds from len(STATUSES) on failed.
STATUSES = (200, 200, 200, 200, 401, 403, 404, 405, 410, 429, 451, 304, 503)

#: Markup that is put behind each text.
MARKED = " {{a|{{b|{{c}}}} d}} '''z''' [[p|q]] <b>x</b>"

#: Angles whose queries are some of the searches; the first that has a query counts.
ANGLES = [(0, "of that and", ["the erst"]), (1, "other", ["the erst", "les eaux"])]
