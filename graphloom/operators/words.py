"""Word lists of the rules, shortest first."""


def _set(text: str, sep: str | None = None) -> tuple[str, ...]:
    return tuple(" ".join(w.split()) for w in text.split(sep) if w.strip())


STOP_LABELS = _set("""
cf eg he ie it we all bad etc few new old one she viz way who case each fact good item kind last like many mode most none part same some sort that
they this time true type unit what whom being class every false first genus great issue large means other place point small state these thing third
those which whole young aspect entity former latter manner matter method moment object period second unmixe another certain element example feature
nothing portion problem several similar species various anything category instance question condition different situation something everything
circumstance
""")
GENERIC_PREDICATES = _set("""
be ; do ; is ; are ; did ; had ; has ; was ; been ; does ; have ; is_a ; like ; said ; says ; were ; being ; is_an ; named ; called ; having ; linked
; related ; relates ; such as ; type_of ; concerns ; contains ; includes ; involved ; involves ; known_as ; pertains ; comprises ; connected ;
linked_to ; associated ; is_type_of ; related_to ; relates_to ; for example ; has_quality ; pertains_to ; connected_to ; has_property ; has_attribute
; associated_with
""", ";")
VALUABLE_PREDICATES = _set("""
means ; moves ; wills ; causes ; thinks ; denotes ; desires ; entails ; animates ; produces ; has power ; perceives ; signifies ; depends on ; is form
of ; is mode of ; contradicts ; has faculty ; is cause of ; is equal to ; is moved by ; is power of ; is prior to ; presupposes ; differs from ; is
caused by ; is less than ; is matter of ; is defined as ; is essence of ; is faculty of ; is animated by ; is contrary to ; is function of ; is
opposite of ; is produced by ; is actuality of ; is attribute of ; is condition of ; is dependent on ; is greater than ; is identical to ; is part of
soul ; is perceived by ; is posterior to ; is substance of ; is distinct from ; is necessary for ; is sufficient for ; is simultaneous with
""", ";")
BLOCKED_PREDICATES = _set("""
at cf eg ie in on or to and but etc see viz from with without
""")
FUNCTION_WORDS = _set("""
a an as at be by do he if in is it no of on or so to us we all and any are but did few for had has her him his its may not now our own she the too was
who also been both does each even from have into just more most must only same some such than that them they this thus very were what when will with
after being could might other still their these those where which while would always before during should already because despite however through
although therefore
""")
CLAUSE_MARKERS = _set("""
or nor from into onto over upon after among under before during within against between despite through towards without
""")
DETERMINERS = _set("""
any few each many some such every other another certain several
""")
QUERY_STOPWORDS = _set("""
a am an as at be by do if in is my no of on or so to all and are but can did few for had has her his how its may nor not our own the too was who why
been does each from have here into just more most must once only same some such than that then this very were what when whom will with your about
above after again being below could might other shall their there these those under until where which while would before during should against because
between compare discuss explain further through contrast describe according relationship
""")
TRAVERSAL_STOPWORDS = _set("""
a an in is of on to are for how the was who why were what when with where which between relationship
""")
PRONOUNS = _set("""
i he it me my us we her him our she you mine ours them they your their yours itself myself theirs herself himself yourself ourselves themselves
""")
STRUCTURAL = _set("""
toc ; index ; chapter ; preface ; section ; appendix ; contents ; introduction ; table of contents
""", ";")
LEGAL_MARKERS = _set("""
refund ; license ; donation ; warranty ; copyright ; terms of use ; project gutenberg ; all rights reserved
""", ";")
ROLE_PREPOSITIONS = _set("""
as at by in on to for from into onto upon with about after before during within without
""")

#: canonical predicate: its variants
SYNONYMS = {
    "is": _set("am ; be ; are ; was ; were ; being", ";"),
    "has": _set("own ; have ; hold ; owns ; holds ; possess ; possesses", ";"),
    "gives": _set("give ; grants ; offers ; bestows ; provide ; provides ; supplies", ";"),
    "knows": _set("know ; recognizes ; understand ; is aware of ; understands", ";"),
    "lacks": _set("lack ; has no ; missing ; is without ; does not have", ";"),
    "makes": _set("make ; forms ; builds ; fashions ; constructs ; fabricates", ";"),
    "called": _set("means ; named ; termed ; known as ; designated ; referred to as", ";"),
    "causes": _set("cause ; create ; creates ; produce ; leads to ; produces ; generates ; results in ; brings about ; gives rise to", ";"),
    "becomes": _set("become ; turns into ; changes into ; evolves into ; transforms into", ";"),
    "believes": _set("think ; thinks ; believe ; regards ; considers ; holds that", ";"),
    "contains": _set("include ; comprise ; includes ; comprises ; encompass ; consists of ; encompasses ; incorporate ; incorporates", ";"),
    "requires": _set("need ; needs ; demands ; require ; depends on ; necessitates", ";"),
    "used for": _set("used as ; serves as ; employed for ; utilized for", ";"),
    "belongs to": _set("belong to ; is part of ; falls under ; is member of", ";"),
    "located in": _set("found in ; exists in ; located at ; resides in ; situated in", ";"),
    "similar to": _set("like ; akin to ; is like ; resembles ; comparable to", ";"),
    "derived from": _set("comes from ; stems from ; arises from ; derives from ; originates from", ";"),
    "associated with": _set("tied to ; linked to ; related to ; connected to", ";"),
}
