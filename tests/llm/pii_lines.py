"""Lines written by hand, apart from both the training text and any corpus; spans are marked ``<<KIND|text>>``."""

LINES = """
Hi team, <<NAME|Laura Bennett>> is out on Friday, so please ask <<NAME|Tom Hargreaves>> instead.
If the alarm rings at night, phone <<PHONE|+1 (312) 867-5390>> and ask for the operator.
The parcel goes to <<ADDRESS|48 Maple Grove Road, Springfield, IL 62704>> before noon.
Her passport number is <<ID_NUMBER|X41872093>> and it runs out in May.
Send the signed form to <<EMAIL|h.kowalska@registry.example.org>> please.
# <<NAME|Dmitri Volkov>> rewrote this function in 2016 because it was slow
/* Originally by <<NAME|M. Fernandez>>, cleaned up later */
We met <<NAME|Sarah O'Neill>> and Mr <<NAME|Rajesh Gupta>> at the station.
// contact: <<EMAIL|ops-lead (at) harbor.example>> or <<PHONE|020 7219 4272>>
employee id <<ID_NUMBER|EMP-55021>> was issued twice
The clinic stores SSN <<ID_NUMBER|219-09-9999>> in plain text, which is a bug.
Bitte schicken Sie den Brief an <<ADDRESS|Lindenstraße 14, 50674 Köln>>.
Frau <<NAME|Katrin Vogel>> erreichen Sie unter <<PHONE|+49 221 4710825>>.
Contactez <<NAME|Hélène Marchand>>, <<ADDRESS|12 rue des Lilas, 69003 Lyon>>.
Mail to <<ADDRESS|PO Box 1482, Wellington>> takes a week.
National insurance number <<ID_NUMBER|QQ 12 34 56 C>> is only an example.
user=<<EMAIL|nina.park@mail.example.com>> failed to log in three times
self.reviewer = "<<NAME|Olu Adeyemi>>"  # fixed reviewer for the demo
Thanks to <<NAME|Bjørn Halvorsen>> for the patch and to everyone who tested it.
"driver_licence": "<<ID_NUMBER|MORGA657054SM9IJ>>"
<<NAME|Chen, Li>>; <<PHONE|555-0142>>; <<EMAIL|li.chen@example.net>>
The board meets at <<ADDRESS|9 Abbey Lane>> every month.
fax <<PHONE|(0)161 496 0000>> is no longer answered
My manager, <<NAME|Isabel Torres>>, approved it.
Steuer-ID: <<ID_NUMBER|86 095 742 719>>
Dear Ms. <<NAME|Tanaka Yuki>>, your order has shipped.
Released under the Mozilla Public License 2.0 by the Example Foundation.
See Algorithm Design, Section 4.2, for a proof of the bound.
The Great Wall and the Eiffel Tower are used as test images.
Order 4417-88-2031 left the warehouse on 2023-11-05 at 14:32:10.
Version 10.4.22621.3007 needs at least 4096 MB of memory.
git remote add origin git@github.com:acme/widgets.git
uuid = "7d444840-9dc0-11d1-b245-5ffdce74fad2"
The checksum 3735928559 does not match the manifest.
for row in range(1000, 2000): total += weights[row]
Machine Learning Engineers use Gradient Boosting every day.
https://user:secret@db.internal.example:5432/main
Server 192.168.14.250:8443 refused the connection.
SELECT Name, Street FROM Customer WHERE Id = 900123456;
npm install left-pad@1.3.0
Copyright 2021 The Wombat Authors. All rights reserved.
Account IBAN GB29 NWBK 6016 1331 9268 19 belongs to the club.
""".strip("\n").split("\n")
