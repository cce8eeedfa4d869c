"""Common words of English, French, German and Spanish that say what stands beside personal information."""

from __future__ import annotations

_w = str.split

# an article is a particle only behind another one ("van den", "de los"), since nouns follow articles, too; "zu" is
# left out, as it stands between German nouns everywhere
PARTICLES = ["van de[nr]?", "von de[mnr]", "von", "van", "de la", "de las", "de los", "del", "della", "de", "di", "da", "dos", "du", "des", "le", "la", "ten", "ter", "y", "bin", "ibn"]
TITLES = set(_w("mr mrs miss ms mx dr prof professor rev reverend fr sir dame lady lord hon judge justice capt captain col colonel maj major gen general lt lieutenant sgt sergeant president senator mayor bishop father sister brother aunt uncle"))
TITLES |= set(_w("m mm mme mmes mlle monsieur madame mademoiselle maître docteur professeur herr herrn frau fräulein doktor don doña d señor señora señorita sr sra srta esq jr"))
# the most frequent given and family names of the four languages
GIVEN = set(_w("james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen daniel matthew anthony mark paul steven andrew emily emma olivia sophie anna laura alice george edward henry peter helen margaret ruth jane rachel hannah grace lucy oliver jack harry samuel benjamin"))
GIVEN |= set(_w("jean pierre michel andré philippe jacques louis françois nicolas marie nathalie isabelle catherine claire camille hélène monique julien antoine hans klaus jürgen wolfgang karl heinz stefan andreas thomas ursula sabine petra monika greta ingrid katharina friedrich johann maria josé juan antonio manuel francisco carlos miguel pedro luis jorge carmen ana isabel dolores pilar lucía elena rosa javier diego"))
FAMILY = set(_w("smith johnson williams brown jones miller davis wilson anderson taylor thomas moore martin jackson thompson white harris clark lewis robinson walker young allen king wright scott green baker adams nelson hill campbell mitchell roberts carter phillips evans turner parker collins edwards stewart morris murphy cook rogers morgan cooper"))
FAMILY |= set(_w("bernard dubois durand dupont leroy moreau laurent lefebvre roux fournier girard lambert mercier rousseau müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz zimmermann garcía rodríguez gonzález fernández lópez martínez sánchez pérez gómez díaz ruiz hernández jiménez moreno álvarez romero torres navarro"))

# nouns that make a capitalised run the name of a body, a place, a text or an office
INSTITUTIONS = set(_w("""company corporation inc ltd llc limited bank trust fund society association union federation league club foundation institute institution academy college school university library museum gallery theatre hospital clinic church chapel cathedral abbey
parish diocese court tribunal bench chamber council committee commission commissioner board bureau office department ministry agency authority assembly parliament congress senate government state county city town village borough district province region republic kingdom empire army navy regiment police
railway railroad canal turnpike airport station harbour harbor port dock wharf pier mill factory works mine farm estate manor hall house castle palace tower inn hotel tavern market exchange insurance press journal gazette times post herald review
new old north south east west upper lower great little saint st san santa bad grand royal national general
street road lane avenue square bridge gate park garden hill mount mountain river lake bay island valley forest wood moor fell ridge creek beach coast cape fort ward act code law bill treaty charter statute report book bible series award prize cup festival brothers sons partners group holdings services systems
compagnie société banque mairie cour conseil ministère université lycée école église hôpital rue gare pont port comté ville loi code gesellschaft verein bank stadt gemeinde amt gericht kammer rat ministerium universität schule kirche krankenhaus bahnhof rathaus schloss burg könig herzog graf bürgermeister brücke fluss see gesetz werk verlag
compañía sociedad banco ayuntamiento tribunal juzgado consejo ministerio universidad escuela iglesia hospital calle plaza puente puerto ciudad ley código río"""))
FUNCTION = set(_w("""the a an this that these those it its he she they we you i my his her our your their who which what when where while why how if as at by for from in into of on off or and but nor so to with without under over after before between since until not no yes all any some each every both many most such same other another
there here then than thus hence dear see also may can shall will would should could must is are was were be been being has have had do does did let please present signed whereas now one two three four five first second third last next
le la les l un une des du de et ou mais si il elle nous vous ils elles on ce cette ces cet dans sur pour par avec sans chez tout toute tous au aux en est qui que dont selon vu attendu à monseigneur
der die das den dem ein eine einem einer eines einen und oder aber wenn im am zum zur von vom mit für auf aus bei nach seit über unter vor wie als auch nicht ist sind war hat es er sie wir ihr dieser diese dieses jeder jede alle kein keine
el los las una unos unas y o pero si en con por para del al este esta estos estas ese esa se su sus lo que quien cuando donde como no sí es son fue ha han todo toda cada"""))
ARTICLES = set(_w("the a an this le la les un une du des ce cette der die das den dem des ein eine einem einen einer eines kein jeder dieser el los las una del al este esta"))
CALENDAR = set(_w("""january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday janvier février mars avril mai juin juillet août septembre octobre novembre décembre lundi mardi mercredi jeudi vendredi samedi dimanche
januar februar märz april juni juli oktober dezember montag dienstag mittwoch donnerstag freitag samstag sonntag enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre lunes martes miércoles jueves viernes sábado domingo easter christmas michaelmas"""))
LOCATIVE = set(_w("at in near from to towards through around across via off beyond within past along à au aux dans vers près en in bei nach aus an zu a desde hacia cerca entre"))
STREETS = {
    "en": _w("Street St St. Road Rd Rd. Lane Ln Ln. Avenue Ave Boulevard Blvd Blvd. Drive Dr. Court Ct. Close Row Terrace Square Place Way Walk Crescent Hill Yard Quay Mews Gardens Parade Alley Wharf Circle Parkway Highway Grove Rise Passage Green Gate"),
    "fr": _w("rue avenue boulevard quai place chemin impasse allée cours route ruelle passage square faubourg sentier villa"),
    "de": _w("straße strasse str. gasse weg platz allee ufer damm ring steig markt chaussee pfad"),
    "es": _w("calle C/ plaza avenida avda. paseo camino travesía ronda callejón plazuela carretera glorieta"),
}
# what a word before or behind a number says it is: 1 phone, 2 number of a person's papers, 3 other reference, 4 measure or money, 5 extension
CUES: dict[str, int] = {}
for _n, _words in enumerate(
    (
        "tel tél telephone téléphone telefon teléfono phone phones mobile mobil móvil portable cell handy fax call calls calling ring dial text whatsapp hotline reach appeler appelez anrufen rufen ruf rufnummer fon unter llamar llame ligar contact dialled",
        "ssn social security sécurité sociale sozialversicherungsnummer passport passeport reisepass pasaporte nino insurance tax taxpayer tin itin steuernummer steuer-id steueridentifikationsnummer idnr ausweis personalausweis ausweisnummer dni nie nif cif documento document papers identity identité identidad licence license führerschein permis permiso pension rente carte id card national fiscal number numéro número nummer no nr n°",
        "page pages p pp folio fol section sec § article art chapter chapitre kapitel capítulo line volume vol act case cause docket suit invoice order ref reference file bundle box lot item serial code isbn issn doi version release report rep question paragraph clause verse psalm bill entry plot parcel room table figure fig batch ticket tracking account iban",
        "cents cent dollars dollar euros euro pounds shillings francs livres marks taler pesos pesetas acres bushels barrels yards feet miles km kg tons per percent degrees hours copies total sum price votes",
        "ext extension apparat poste extensión durchwahl",
    ),
    1,
):
    for _x in _w(_words):
        CUES.setdefault(_x, _n)
