"""Titles and given names by which op8 finds persons; wider than the lists it makes surrogates from.

Given names that are also common words, months or places (May, Will, Victoria) are left out: they are
found after a title only.
"""

TITLES_M = [
    *["Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Senhor", "Pan"],
    *["г-н", "господин", "Господин", "κύριος", "Κύριος", "κ", "Κος"],
]
TITLES_F = [
    *["Mrs", "Ms", "Miss", "Madam", "Lady", "Dame", "Frau", "Fräulein", "Madame", "Mme", "Mlle", "Mademoiselle"],
    *["Señora", "Señorita", "Sra", "Srta", "Doña", "Signora", "Signorina", "Senhora", "Pani", "Dra"],
    *["г-жа", "госпожа", "Госпожа", "κυρία", "Κυρία", "Κα"],
]
TITLES_ANY = [
    *["Dr", "Doctor", "Doktor", "Prof", "Professor", "Professeur", "Mx", "Rev", "Reverend", "Capt", "Captain", "Lt", "Lieutenant"],
    *["Sgt", "Sergeant", "Sen", "Senator", "Gov", "Governor", "Judge", "Dipl.-Ing", "Ing", "Dott", "Maître"],
    *["д-р", "доктор", "Доктор", "проф", "профессор", "Профессор", "δρ", "Δρ", "Δρ", "καθηγητής", "Καθηγητής"],
]
MALE = """
James John Robert Michael David William Thomas Peter Paul Mark Hans Karl Jean Pierre Carlos Juan Richard Joseph Charles
Christopher Daniel Matthew Anthony Donald Steven Steve Stephen Andrew Andy Kenneth Joshua Kevin Brian Bryan George Georg Timothy
Ronald Edward Jason Jeffrey Jeff Ryan Jacob Gary Nicholas Nick Eric Erik Jonathan Larry Justin Scott Brandon Benjamin Ben
Samuel Sam Gregory Greg Alexander Alex Frank Patrick Raymond Jack Dennis Jerry Tyler Aaron Jose José Adam Nathan Henry Henri Zachary
Douglas Doug Kyle Noah Ethan Jeremy Walter Walther Keith Roger Terry Sean Shaun Gerald Harold Carl Arthur Lawrence Dylan
Jesse Bryce Joe Billy Bruce Gabriel Logan Alan Allan Allen Ralph Roy Eugene Russell Vincent Philip Phillip Bobby Johnny
Jim Jimmy Tom Tommy Tim Mike Dave Bob Rob Chris Dan Matt Tony Ken Ron Ed Eddie Harry Oliver Liam Lucas Luke Lukas Leo Leon
Louis Luis Mason Elijah Isaac Owen Caleb Connor Hugo Ian Ivan Igor Oscar Oskar Otto Max Felix Fritz Franz Friedrich
Heinrich Jürgen Jurgen Klaus Dieter Günter Gunter Günther Helmut Herbert Horst Johann Johannes Jonas Josef Kurt Ludwig Manfred
Markus Martin Matthias Niklas Norbert Rainer Rolf Rudolf Sebastian Stefan Sven Tobias Uwe Volker Werner Wilhelm Wolfgang
Jacques François Francois Michel Alain Philippe Bernard Claude Christophe Nicolas Olivier Laurent Thierry Julien Antoine
Guillaume Mathieu Marcel René Rene Étienne Luc Yves Antonio Manuel Francisco Javier Miguel Jesús Pedro Alejandro Rafael Fernando
Pablo Jorge Sergio Alberto Andrés Andres Diego Ramón Enrique Eduardo Roberto Ricardo Raúl Mario Marco Giovanni Giuseppe Luigi
Francesco Paolo Andrea Alessandro Stefano Matteo Lorenzo Luca Angelo Vincenzo Salvatore João Joao Paulo Tiago Gustavo Felipe
Rodrigo Mateus Jan Pieter Willem Kees Lars Anders Björn Nils Olaf Ole Per Søren Mikkel Piotr Paweł Krzysztof Andrzej Tomasz Marek
Vladimir Dmitri Dmitry Sergei Sergey Andrei Alexei Mikhail Nikolai Oleg Pavel Yuri Boris Mohammed Muhammad Mohamed Ahmed Ali
Omar Hassan Hussein Ibrahim Yusuf Khalid Mustafa Mehmet Raj Rajesh Ravi Rahul Amit Sanjay Vijay Suresh Arjun Anil Arun Deepak
Krishna Wei Ming Jun Hiroshi Takashi Kenji Yuki Satoshi Minh Kwame Kofi Emeka Chukwu Tunde Abdul Abdullah Bilal Imran Tariq
Иван Пётр Петр Сергей Андрей Михаил Павел Николай Олег Александр Алексей Дмитрий Владимир Юрий Борис Виктор Игорь Максим Евгений
Константин Антон Артём Артем Роман Василий Григорий Фёдор Илья Никита Денис Станислав Валерий Анатолий Леонид Вячеслав Кирилл
Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος Πέτρος Ανδρέας Γεώργιος Νικόλαος Δημήτριος Κωνσταντίνος Ιωάννης Χρήστος Βασίλης
Σπύρος Θανάσης Παναγιώτης Μιχάλης Αλέξανδρος Στέφανος Ηλίας Αντώνης Μανώλης Θεόδωρος Σταύρος
""".split()
FEMALE = """
Mary Anna Linda Susan Karen Sarah Emma Laura Julia Helen Greta Marie Claire Sophie Carmen Lucia Patricia Jennifer Jenny Elizabeth
Barbara Jessica Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Debra Stephanie
Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine Catherine Kathryn Christine
Christina Rachel Carolyn Janet Maria Heather Diane Diana Julie Joyce Evelyn Joan Kelly Lauren Judith Olivia Martha Cheryl Megan
Andrea Ann Anne Annie Alice Jean Doris Jacqueline Hannah Gloria Teresa Theresa Kathy Sara Janice Frances Marilyn Danielle
Beverly Isabella Isabel Natalie Denise Brittany Amber Abigail Sophia Alexis Kayla Lori Jane Ruth Judy Grace Rose Ella Mia Zoe Chloe
Lily Lucy Ellen Eleanor Nora Eva Eve Irene Ingrid Ursula Monika Monica Petra Sabine Susanne Renate Brigitte Gisela Heike Helga
Elke Ute Birgit Katrin Claudia Stefanie Katharina Christina Martina Silke Anja Tanja Nadine Lena Leonie Johanna Heidi Hilde
Françoise Francoise Monique Nathalie Isabelle Sylvie Martine Valérie Valerie Sandrine Véronique Celine Céline Aurélie Camille Manon
Amélie Élodie Juliette Margaux Léa Chantal Brigitte Josefa Ana María Isabel Dolores Pilar Teresa Cristina Marta Elena Rosa
Mercedes Raquel Beatriz Sofía Sofia Paula Alejandra Gabriela Daniela Valentina Camila Fernanda Juana Inés Luisa Giulia Francesca
Chiara Giovanna Paola Alessandra Silvia Federica Valeria Elisa Giorgia Mariana Beatriz Larissa Katarzyna Agnieszka Małgorzata
Ewa Zofia Astrid Birgitta Karin Kirsten Annika Freya Sigrid Olga Natalia Natasha Tatiana Svetlana Irina Ekaterina Yelena Ludmila
Fatima Aisha Khadija Zainab Maryam Layla Leila Amina Noor Priya Anjali Deepa Sunita Lakshmi Kavita Pooja Neha Mei Ling Xiu Yan
Sakura Yoko Keiko Aiko Hanako Thu Linh Ngozi Chioma Amara Wanjiru Tracy Tiffany Crystal Vanessa Veronica Wendy Yvonne Vera Sheila
Sally Robin Rhonda Phyllis Peggy Paige Molly Miranda Melanie Meghan Lynn Lorraine Leslie Kristen Kristin Kristina Kate Katie Jill Jo
Joanna Joanne Hilary Gwen Gina Gail Erin Erica Elaine Edith Dorothy Dana Courtney Connie Colleen Cindy Caroline Bonnie Bethany
Becky Audrey Anita Alison Allison Agnes Ada Adele Maya Naomi Nina Ruby Stella Sylvia
Анна Мария Ольга Елена Наталья Ирина Татьяна Вера Екатерина Светлана Юлия Анастасия Людмила Галина Марина Дарья Александра
Надежда Любовь Ксения Валентина Полина Нина Алина София Виктория Евгения Лариса Тамара Оксана Вероника Маргарита
Μαρία Ελένη Άννα Σοφία Κατερίνα Δήμητρα Ιωάννα Αγγελική Γεωργία Βασιλική Παναγιώτα Χριστίνα Ευαγγελία Αικατερίνη Κωνσταντίνα Ειρήνη
Δέσποινα Θεοδώρα Φωτεινή Αναστασία
""".split()
MALE = sorted(set(MALE) - set(FEMALE) | {"Jean"})
FEMALE = sorted(set(FEMALE) - {"Jean"})


def either(words: list[str]) -> str:
    """A pattern of exactly these words, that looks at each character once."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    ends = "" in heads
    heads.pop("", None)
    quoted = [("\\" if not (h.isalnum() or h == "-") else "") + h + either(rest) for h, rest in heads.items()]
    if not quoted:
        return ""
    body = "|".join(quoted)
    return (f"(?:{body})?" if ends else f"(?:{body})") if len(quoted) > 1 or ends else body
