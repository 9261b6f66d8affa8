"""Older parameter sets, as text in the format of parameter files."""

#: Fixed values.
V0_1 = """
name default
version 0.1
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071797551315
Kd_AU 1715.213260625828
Kd_GU 17152.13260625828
C_init 0.004019840263220286
l 1.0
l_BP 1.913629197723873
K_coax 10.0
l_coax 1.0
C_eff_stacked_pair 161184.266309
"""

#: Fixed values.
V0_15 = """
name default
version 0.15
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071797551315
Kd_AU 255455.56614259817
Kd_GU 3857.643586142963
C_init 35.509535390803364
l 1.0
l_BP 1.913629197723873
C_eff_stacked_pair 161184.266309
K_coax 0.0
l_coax 1.0
"""

#: Fixed values.
V0_16 = """
name default
version 0.16
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071797551315
Kd_AU 100000
Kd_GU 100000
C_init 35.509535390803364
l 1.0
l_BP 1.913629197723873
C_eff_stacked_pair 266072.50597988087
K_coax 0.0
l_coax 1.0
"""

#: Fixed values.
V0_17 = """
name default
version 0.17
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071797551315
Kd_AU 100000
Kd_GU 100000
C_init 10.0
l 1.0
l_BP 1.913629197723873
C_eff_motif_NN_WC_NN_WC 266072.50597988087
C_eff_motif_NG_UN_WC 63095.7344480193
C_eff_motif_NU_GN_WC 1000.0
C_eff_motif_GG_UU 10000.0
C_eff_motif_UG_UG 10000.0
C_eff_motif_GU_GU 10000.0
K_coax 5.0
l_coax 1.0
"""

#: Fixed values.
V0_171 = """
name default
version 0.171
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071797551315
Kd_AU 100000
Kd_GU 100000
C_init 3.1622776601683795
l 1.0
l_BP 1.913629197723873
C_eff_motif_NN_WC_NN_WC 158489.3192461114
C_eff_motif_NG_UN_WC 12589.254117941662
C_eff_motif_NU_GN_WC 398107.1705534969
C_eff_motif_GG_UU 79432.82347242821
C_eff_motif_UG_UG 10000.0
C_eff_motif_GU_GU 10000.0
K_coax 2.6302679918953817
l_coax 1.0
"""

#: Fixed values.
V0_18 = """
name default
version 0.18
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071797551315
Kd_AU 78906.7357
Kd_GU 119020.154
C_init 10.8730748
l 0.871441822
l_BP 1.31021656
C_eff_motif_NN_WC_NN_WC 162421.599
C_eff_motif_NG_UN_WC 43152.5943
C_eff_motif_NU_GN_WC 388475.160
C_eff_motif_GG_UU 77237.2169
C_eff_motif_UG_UG 10000.0000
C_eff_motif_GU_GU 302733.329
K_coax 0.0
l_coax 1.0
"""

#: Fixed values.
V0_20 = """
name default
version 0.20
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071798
Kd_AU 2072.686440
Kd_GU 2752.476233
C_init 8.885597
l 0.782422
l_BP 2.018969
K_coax 0.00
l_coax 1.00
C_eff_motif_CC_GG 11408.938246
C_eff_motif_CG_CG 8707.587054
C_eff_motif_CA_UG 7350.309391
C_eff_motif_CU_AG 10012.707190
C_eff_motif_CG_UG 2966.611327
C_eff_motif_CU_GG 10021.315152
C_eff_motif_GC_GC 5592.011226
C_eff_motif_GA_UC 7719.504224
C_eff_motif_GU_AC 9519.312818
C_eff_motif_GG_UC 2859.661782
C_eff_motif_GU_GC 6147.860062
C_eff_motif_AA_UU 5472.108440
C_eff_motif_AU_AU 3342.600892
C_eff_motif_AG_UU 2921.080083
C_eff_motif_AU_GU 3276.886414
C_eff_motif_UA_UA 8172.968716
C_eff_motif_UG_UA 3624.078763
C_eff_motif_UU_GA 4169.337614
C_eff_motif_GG_UU 11133.462491
C_eff_motif_GU_GU 3563.691560
C_eff_motif_UG_UG 4870.967783
"""

#: Fixed values.
V0_30 = """
name default
version 0.30
min_loop_length 3
allow_strained_3WJ False
Kd_CG 762.071798
Kd_AU 7372.206287
Kd_GU 17378.420597
C_init 10.001552
l 0.791198
l_BP 1.706068
C_eff_motif_NN_NN 46827.702666
C_eff_motif_NN_NNN 353.977155
C_eff_motif_NN_NNNN 58.427771
C_eff_motif_NN_NNNNN 2.555806
C_eff_motif_NNN_NNN 1126.455162
C_eff_motif_NNN_NNNN 144.398010
C_eff_motif_NNN_NNNNN 66.473753
C_eff_motif_NNNN_NNNN 672.525066
C_eff_motif_NNNN_NNNNN 0.116215
C_eff_motif_NNNNN_NNNNN 0.099984
C_eff_motif_NNNNN 0.098858
C_eff_motif_NNNNNN 18.253115
C_eff_motif_NNNNNNN 7.872164
C_eff_motif_NNNNNNNN 4.391261
C_eff_motif_NNNNNNNNN 20.715110
C_eff_motif_NNNNNNNNNN 2.572485
C_eff_motif_NNNNNNNNNNN 6.978898
C_eff_motif_NNNNNNNNNNNN 43.956759
C_eff_motif_NGNAAN 74.249746
C_eff_motif_NGNGAN 61.854167
C_eff_motif_NUNCGN 2689.870489
"""

SETS = {"v0.1": V0_1, "v0.15": V0_15, "v0.16": V0_16, "v0.17": V0_17, "v0.171": V0_171, "v0.18": V0_18, "v0.20": V0_20, "v0.30": V0_30}
