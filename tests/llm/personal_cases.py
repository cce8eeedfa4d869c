"""Texts with the personal information in them, written by hand and apart from the training templates.

``@kind{...}`` marks a case; what is not marked must not be found.
"""

import re

MARK = re.compile(r"@(email|phone|id_number|address|name)\{([^{}]*)\}")

WRITTEN = """
Hello, this is @name{Sarah Connor} from the garage; my cell is @phone{(310) 555-0142}.
We hired @name{John Smith} last spring and he quit in June.
Mit @name{Hans Müller} habe ich gestern gesprochen, er ist unter @phone{089 5550 1234} erreichbar.
Le boulanger, @name{Jean Dupont}, ouvre à six heures.
Send your CV to @email{mgarcia@hospital.org} before Friday.
@name{Oliver Twist} asked for more, and nobody at the Royal Albert Hall laughed.
The cheque is payable to @name{Margaret O'Brien}, @address{42 Wallaby Way}, Sydney.
Sherlock rooms at @address{221B Baker Street}, London.
Mrs. @name{Eleanor Whitcombe} left her umbrella in the Lake District.
On Tuesday the Bank of England raised rates again.
My SSN is @id_number{219-09-9999}, please do not share it.
New York, Los Angeles and San Francisco are far apart.
Reservation under @name{Fernández, Lucía} for two; phone @phone{+34 612 345 678}.
Contact the press office: @email{press.office@ministry.gov} or @phone{020 7946 0018}.
Invoice 2023-00417 dated 12/05/2023 totals 1,299.00 dollars.
@name{Tomasz Kowalski} and @name{Agnieszka Nowak} run the bakery on the corner.
Chapter 12 begins on page 348 of the second volume.
Her new passport, @id_number{C03005988}, arrived on Monday.
Monsieur @name{Philippe Marchand} demeure @address{18 rue des Lilas}, à Dijon.
Die Familie wohnt seit Jahren in der @address{Bergstraße 27} und zieht bald um.
@address{1600 Pennsylvania Avenue} is a famous house.
Escríbame a @email{lucia.fernandez@correo.es} cuando llegue.
Flight BA 2490 leaves Gate 14 at 10.45.
Version 4.1.2 of the library fixes bug 10234.
The Prince Albert Canal was dug by hand.
I owe everything to my teacher, @name{Dr. K. Iyer}, said nobody.
Please ask @name{Mei-Ling Chow} about the piano.
Reach me: @email{bob_77@proton.me}
The reference is @email{j.doe (at) firm.com}, as on the poster.
Nuestra abuela, @name{Carmen Ruiz}, cocinaba los domingos.
El piso está en @address{Calle Mayor 15}, tercero derecha.
Call @phone{1-800-555-0199} and ask for extension 12.
The novel by @name{Henry James} sold 4,500 copies in Boston.
Elizabeth Street Market opens at nine.
Herr @name{Jürgen Habermas} sprach im Rathaus von Starnberg.
Her national insurance number is @id_number{QQ 12 34 56 C}.
Les députés de la Chambre ont voté la loi du 9 mars 1891.
Das Buch der Stadt Köln liegt im Amt.
Signed in the presence of @name{William H. Bonney}, the 4th of July, 1879.
The parcel 1Z999AA10123456784 was lost near Mount Vernon.
@name{Li Wei} prefers tea, @name{Ahmed Hassan} coffee.
NIE @id_number{X1234567L} caducado; renovar en Sevilla.
Il faut appeler le @phone{01 42 68 53 00} après dix heures.
His brother @name{Peter Parker} works for the Daily Bugle.
Our office moved from @address{9 Mill Lane} to @address{110 Queen Victoria Road}.
Tickets cost 25 euros, children 12.
Mail @email{support@bigcorp.io} and mention ticket 88213.
The winner, @name{Grace Hopper}, thanked the United States Navy.
The King James Bible was printed in 1611.
Numéro de sécurité sociale @id_number{2 69 05 49 588 157 80}.
The IP address 192.168.10.254 belongs to the printer.
DNI @id_number{12345678Z}, a nombre de @name{Antonio López}.
ISBN 978-3-16-148410-0 is out of print.
Der Angeklagte @name{Karl von Moor} schwieg.
Ich heiße @name{Lena Vogel} und komme aus Bad Homburg.
Saint Bernard dogs rescue travellers on the Great Pass.
The George Washington Bridge is closed.
"""


def cases() -> list[tuple[str, set[tuple[str, str]]]]:
    out = []
    for line in WRITTEN.strip().split("\n"):
        found = {(k, s.removeprefix("Dr. ")) for k, s in MARK.findall(line)}
        out.append((MARK.sub(lambda m: m.group(2), line), found))
    return out
