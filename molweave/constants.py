"""Numbers and lists that results depend on, kept in one place."""

from __future__ import annotations

# --- fixed values: van-der-Waals radii by element; any other element uses carbon's
VDW_RADII = {
    "H": 1.2,
    "C": 1.7,
    "N": 1.55,
    "O": 1.52,
    "F": 1.47,
    "P": 1.8,
    "S": 1.8,
    "Cl": 1.75,
    "Br": 1.85,
    "I": 1.98,
}
DEFAULT_RADIUS_ELEMENT = "C"

# --- fixed values: cavity sweep and contacts
CORNER_PENALTY = 12
GRID_STEP = 0.5
CAVITY_GAPS = (3.5, 4.0, 3.5)  # x, y and z sweep
SITE_PERCENT = 20
CONTACT_CUTOFF = 4.5
MIN_BOX_ATOMS = 10

# --- fixed values: default binding-site box (centre, size)
BOX_CENTRE = (-26.9, 21.9, -76.9)
BOX_SIZE = (30.0, 30.0, 30.0)

# --- fixed values: fingerprints
CHEM_WIDTH = 1024
CHEM_RADIUS = 2

# --- fixed values: screening and report
CONTACT_YES_PERCENT = 70
CONTACT_TOP_PERCENT = 60
CHEM_YES_PERCENT = 80
CHEM_TOP_PERCENT = 75
MAX_PER_CLUSTER = 30
MAX_REPORT = 150
SIMILAR_SHOWN = 3
ESSENTIAL_THRESHOLD = 1.4
EMPTY_NEGATIVE_SCORE = 0.1
SUMMARY_MODES = 3
MIN_ISOLATED = 10

# --- fixed values: report bands and image addresses (text only, nothing is fetched)
BAND_RED_BELOW = 1.5
BAND_GREEN_FROM = 1.7
COMPOUND_IMAGE = "http://zinc.docking.org/img/sub/%s.gif"
LIGAND_IMAGE = "http://www.rcsb.org/pdb/images/%s_270.gif"

# --- fixed values: default labelled compound ids
INHIBITOR_IDS = (
    331, 1353, 1906, 2000, 2066, 2121, 2157, 2562, 2925, 3065, 3097, 3192, 3225, 3254, 3544,
    3584, 3693, 3694, 3897, 3904, 4339, 4393, 4480, 4617, 4911, 5304, 5308, 8711, 133236,
    28714, 29843, 32983, 33051, 34911, 65084, 110209, 137720, 147913, 171462, 388601,
    392692, 392977, 393569, 394812, 394942, 581047, 8082544, 1265915, 2871682, 3512137,
    4444105, 4444112, 4445953, 4510145, 5365258, 8081394, 8098374, 8443182, 8530675,
    9569918, 10442653, 10442740, 20572535, 21106585, 23122887, 23122889, 23122978, 25057753,
)
NOT_INHIBITOR_IDS = (
    650, 682, 733, 864, 971, 1116, 1512, 1710, 2971, 3350, 5611, 5653, 5764, 5768, 6170,
    6257, 6312, 7742, 10610, 73505, 83361, 96749, 111188, 120261, 216840, 391555, 392800,
    4576521, 8257952, 20572534, 23122865, 23122927, 23123076, 112728, 10442445,
)

# --- fixed values: chemical elements as name, symbol, atomic number, mass
ELEMENTS_TSV = """\
Actinium	Ac	89	227.028
Aluminum	Al	13	26.981539
Americium	Am	95	243
Antimony	Sb	51	121.757
Argon	Ar	18	39.948
Arsenic	As	33	74.92159
Astatine	At	85	210
Barium	Ba	56	137.327
Berkelium	Bk	97	247
Beryllium	Be	4	9.012182
Bismuth	Bi	83	208.98037
Bohrium	Bh	107	262
Boron	B	5	10.811
Bromine	Br	35	79.904
Cadmium	Cd	48	112.411
Calcium	Ca	20	40.078
Californium	Cf	98	251
Carbon	C	6	12.011
Cerium	Ce	58	140.115
Cesium	Cs	55	132.90543
Chlorine	Cl	17	35.4527
Chromium	Cr	24	51.9961
Cobalt	Co	27	58.93320
Copper	Cu	29	63.546
Curium	Cm	96	247
Dubnium	Db	105	262
Dysprosium	Dy	66	162.50
Einsteinium	Es	99	252
Erbium	Er	68	167.26
Europium	Eu	63	151.965
Fermium	Fm	100	257
Fluorine	F	9	18.9984032
Francium	Fr	87	223
Gadolinium	Gd	64	157.25
Gallium	Ga	31	69.723
Germanium	Ge	32	72.61
Gold	Au	79	196.96654
Hafnium	Hf	72	178.49
Hassium	Hs	108	265
Helium	He	2	4.002602
Holmium	Ho	67	164.93032
Hydrogen	H	1	1.00794
Indium	In	49	114.82
Iodine	I	53	126.90447
Iridium	Ir	77	192.22
Iron	Fe	26	55.847
Krypton	Kr	36	83.80
Lanthanum	La	57	138.9055
Lawrencium	Lr	103	262
Lead	Pb	82	207.2
Lithium	Li	3	6.941
Lutetium	Lu	71	174.967
Magnesium	Mg	12	24.3050
Manganese	Mn	25	54.93805
Meitnerium	Mt	109	266
Mendelevium	Md	101	258
Mercury	Hg	80	200.59
Molybdenum	Mo	42	95.94
Neodymium	Nd	60	144.24
Neon	Ne	10	20.1797
Neptunium	Np	93	237.048
Nickel	Ni	28	58.6934
Niobium	Nb	41	92.90638
Nitrogen	N	7	14.00674
Nobelium	No	102	259
Osmium	Os	76	190.2
Oxygen	O	8	15.9994
Palladium	Pd	46	106.42
Phosphorus	P	15	30.973762
Platinum	Pt	78	195.08
Plutonium	Pu	94	244
Polonium	Po	84	209
Potassium	K	19	39.0983
Praseodymium	Pr	59	140.90765
Promethium	Pm	61	145
Protactinium	Pa	91	231.0359
Radium	Ra	88	226.025
Radon	Rn	86	222
Rhenium	Re	75	186.207
Rhodium	Rh	45	102.90550
Rubidium	Rb	37	85.4678
Ruthenium	Ru	44	101.07
Rutherfordium	Rf	104	261
Samarium	Sm	62	150.36
Scandium	Sc	21	44.955910
Seaborgium	Sg	106	263
Selenium	Se	34	78.96
Silicon	Si	14	28.0855
Silver	Ag	47	107.8682
Sodium	Na	11	22.989768
Strontium	Sr	38	87.62
Sulfur	S	16	32.066
Tantalum	Ta	73	180.9479
Technetium	Tc	43	98
Tellurium	Te	52	127.60
Terbium	Tb	65	158.92534
Thallium	Tl	81	204.3833
Thorium	Th	90	232.0381
Thulium	Tm	69	168.93421
Tin	Sn	50	118.710
Titanium	Ti	22	47.88
Tungsten	W	74	183.85
Uranium	U	92	238.0289
Vanadium	V	23	50.9415
Xenon	Xe	54	131.29
Ytterbium	Yb	70	173.04
Yttrium	Y	39	88.90585
Zinc	Zn	30	65.39
Zirconium	Zr	40	91.224
"""
