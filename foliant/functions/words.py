"""Word lists. Results depend on these exact words."""

INDEX_STOP = (
    "a an the is are was were be been being have has had do does did will would could should may might must shall can need dare ought used "
    "to of in for on with at by from as into through during before after above below between under again further then once here there when "
    "where why how all each few more most other some such no nor not only own same so than too very just and but if or because until while "
    "about what which who whom this that these those i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves"
).split()

SEARCH_STOP = "the and for are with that this from what how was were has have had you your all any can will its into than then there their which".split()

QUERY_STOP = (
    "what is the a an how does do are in on at to for of with and or this that it from by was were be can could would should will has have "
    "had not but if then than so as there their they its about which when who whom all each every both few more most other some such no nor "
    "only own same too very just because"
).split()

FILLER = "the is a an and or but in on at to for of with this that it from by was were be have has had are will would".split()
