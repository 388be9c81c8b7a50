"""Printed titles and what they name, entries and the names that tell them apart."""

#: A title, and the fields that it must give.
TITLES = [
    ("Plaintiff's Complaint for Damages", {"canonical": "Complaint"}),
    ("PLAINTIFF'S OPPOSITION TO DEFENDANT STATEWIDE PHYSICIANS'SERVICE DBA PACIFIC INSURANCE OF CALIFORNIA'S MOTION TO STRIKE PUNITIVE DAMAGES IN PLAINTIFF JORDAN AVERY'S SECOND AMENDED COMPLAINT", {"canonical": "Opposition", "target": "Mot."}),
    ("PLAINTIFF'S OPPOSITION TO DEFENDANT'S DEMURRER TO SECOND AMENDED COMPLAINT", {"canonical": "Opposition", "target": "Demurrer"}),
    ("SECOND AMENDED COMPLAINT", {"canonical": "SAC"}),
    ("PACIFIC INSURANCE'S NOTICE OF DEMURRER AND DEMURRER TO PLAINTIFF'S SAC CASE NO. 30STCV12345", {"canonical": "Demurrer", "target": "SAC"}),
    ("DEFENDANT PACIFIC INSURANCE'S MOTION TO STRIKE PUNITIVE DAMAGES IN SECOND AMENDED COMPLAINT CASE NO. 30STCV12346", {"canonical": "Motion", "target": "Mot. to Strike Punitive Damages"}),
    ("CREDITCO'S MOTION TO COMPEL ARBITRATION AND FOR A STAY", {"canonical": "Motion", "target": "Mot. to Compel Arbitration and for a Stay"}),
    ("SMITH DECL. I/S/O CREDITCO'S MOTION TO COMPEL ARBITRATION AND FOR A STAY", {"canonical": "Smith Decl. ISO Mot."}),
    ("DECLARATION OF OLIVIA BENNETT IN SUPPORT OF PLAINTIFF'S OPPOSITION TO CREDITCO'S MOTION TO COMPEL ARBITRATION", {"canonical": "Bennett Decl. ISO Opp."}),
    ("PLAINTIFF'S OPPOSITION TO CREDITCO'S MOTION TO COMPEL ARBITRATION", {"canonical": "Opposition", "target": "Mot."}),
    ("CONNORS DECLARATION", {"canonical": "Connors Decl."}),
    ("DECLARATION OF MARCUS WEBB IN SUPPORT OF PLAINTIFF'S OPPOSITION TO CREDITCO'S MOTION TO COMPEL ARBITRATION", {"canonical": "Webb Decl. ISO Opp."}),
    ("DEFENDANT THE BOARD OF TRUSTEES OF EXAMPLE UNIVERSITY'S NOTICE OF DEMURRER AND DEMURRER TO PLAINTIFF'S First Amended Complaint (FAC)", {"canonical": "Demurrer", "target": "FAC"}),
    ("COMPLAINT FOR COMPENSATORY, PUNITIVE, AND LIQUIDATED DAMAGES, INJUNCTIVE RELIEF, AND CIVIL PENALTIES HOPKINS V. BRIGHT TUTORS LLC, ET AL", {"canonical": "Complaint", "party": "Hopkins"}),
    ("Defendant's Reply to Opposition to Motion to Compel Arbitration", {"canonical": "Reply", "target": "Opp. to Mot."}),
    ("Plaintiff's Reply to Opposition to Motion for Summary Judgment", {"canonical": "Reply", "target": "Opp. to Mot."}),
    ("Defendant's Reply to Plaintiff's Opposition to Demurrer", {"canonical": "Reply", "target": "Opp. to Demurrer"}),
    ("Defendant's Notice of Motion and Motion to Compel Arbitration", {"canonical": "Motion", "target": "Mot. to Compel Arbitration"}),
    ("Notice of Motion for Summary Judgment", {"canonical": "Motion", "target": "Mot. for Summary Judgment"}),
    ("Plaintiff's Notice of Motion and Motion to Strike Defendant's Answer", {"canonical": "Motion", "target": "Mot. to Strike Defendant's Answer"}),
    ("Petition to Compel Arbitration and for a Stay", {"canonical": "Petition", "target": "Pet. to Compel Arbitration and for a Stay"}),
    ("Petitioner's Petition to Confirm Arbitration Award", {"canonical": "Petition", "target": "Pet. to Confirm Arbitration Award"}),
    ("Petition for Writ of Mandate", {"canonical": "Petition", "target": "Pet. for Writ of Mandate"}),
    ("Respondent's Opposition to Petition to Compel Arbitration", {"canonical": "Opposition", "target": "Pet."}),
    ("Petitioner's Reply to Opposition to Petition for Writ of Mandate", {"canonical": "Reply", "target": "Opp. to Pet."}),
    ("Declaration of Jane Smith in Support of Reply to Opposition to Motion to Compel Arbitration", {"canonical": "Smith Decl. ISO Reply"}),
    ("Declaration of John Doe in Support of Petition to Confirm Award", {"canonical": "Doe Decl. ISO Pet."}),
    ("DECLARATION OF SOMEONE IN SUPPORT OF DEFENDANT'S MOTION TO STRIKE", {"canonical": "Someone Decl. ISO Mot."}),
    ("DECLARATION OF MARIA GARCIA-LOPEZ IN SUPPORT OF OPPOSITION", {"canonical": "Garcia-Lopez Decl. ISO Opp."}),
    ("Declaration of Smith", {"canonical": "Smith Decl."}),
    ("Defendant's Ex Parte Application for Order Shortening Time", {"canonical": "Ex Parte Application", "target": "Ex Parte App. for Order Shortening Time"}),
    ("RECEIVER'S OPPOSITION TO DEFENDANTS' EX PARTE APPLICATION", {"canonical": "Opposition", "target": "Ex Parte App.", "party_label": "Receiver"}),
    ("Defendant Pacific Insurance's Reply to Opposition to Ex Parte Application", {"canonical": "Reply", "target": "Opp. to Ex Parte App.", "party_label": "Defendant", "party_name": "Pacific Insurance"}),
    ("Declaration of Jane Smith in Support of Ex Parte Application", {"canonical": "Smith Decl. ISO Ex Parte App."}),
    ("Plaintiff's Complaint for Damages", {"canonical": "Complaint", "party_label": "Plaintiff"}),
    ("Defendant Pacific Insurance's Demurrer to SAC", {"canonical": "Demurrer", "target": "SAC", "party_label": "Defendant", "party_name": "Pacific Insurance"}),
    ("Receiver's Opposition to Defendants' Ex Parte Application", {"canonical": "Opposition", "target": "Ex Parte App.", "party_label": "Receiver"}),
    ("Creditco's Motion to Compel Arbitration", {"canonical": "Motion", "party_label": "Creditco"}),
    ("Plaintiff Jordan Avery's Opposition to Defendant's Motion", {"canonical": "Opposition", "target": "Mot.", "party_label": "Plaintiff", "party_name": "Jordan Avery"}),
    ("Plaintiff John Doe's Motion to Compel Arbitration", {"canonical": "Motion", "party_label": "Plaintiff", "party_name": "John Doe"}),
    ("Plaintiff's Opposition to Demurrer", {"canonical": "Opposition", "party_label": "Plaintiff", "party_name": None}),
    ("Declaration of John Doe in Support of Plaintiff Jane Roe's Opposition to Motion for Summary Judgment", {"canonical": "Doe Decl. ISO Opp."}),
    ("Acme Corp LLC's Motion to Dismiss", {"canonical": "Motion", "party_label": "Acme Corp LLC"}),
    ("Plaintiffs Req for Judicial Notice in Support Opp to Demurrer by Example & Partners TAC", {"canonical": "RJN ISO Opp.", "target": "Opp. to Demurrer"}),
    ("Plaintiff's Request for Judicial Notice in Support of Opposition to Demurrer", {"canonical": "RJN ISO Opp.", "target": "Opp. to Demurrer", "party_label": "Plaintiff"}),
    ("RJN ISO Motion to Compel", {"canonical": "RJN ISO Mot."}),
    ("Defendant's Request for Judicial Notice", {"canonical": "RJN", "party_label": "Defendant"}),
    ("Smith Declaration ISO RJN", {"canonical": "Smith Decl. ISO RJN"}),
    ("Req. for Judicial Notice in Support of Motion for Summary Judgment", {"canonical": "RJN ISO Mot."}),
    ("EXAMPLE BUILDING PRODUCTS, INC.'S SEPARATE STATEMENT IN REPLY TO PLAINTIFF'S ADDITIONAL MATERIAL FACTS RE: MOTION FOR SUMMARY JUDGMENT", {"canonical": "Reply Separate Statement"}),
    ("Plaintiff's Separate Statement in Opposition to Motion for Summary Judgment", {"canonical": "UMF", "party_label": "Plaintiff"}),
    ("Separate Statement of Undisputed Material Facts", {"canonical": "Separate Statement"}),
    ("PLAINTIFF'S SEPARATE STATEMENT OF ADDITIONAL UNDISPUTED MATERIAL FACTS IN SUPPORT OF OPPOSITION TO MSJ", {"canonical": "AUMF", "party_label": "Plaintiff"}),
    ("Defendant's Separate Statement of Additional Material Facts", {"canonical": "AUMF", "party_label": "Defendant"}),
    ("PLAINTIFF'S RESPONSE TO DEFENSE SEPARATE STATEMENT OF UNDISPUTED MATERIAL FACTS", {"canonical": "UMF", "party_label": "Plaintiff"}),
    ("Plaintiff's Responses to Defendant's Separate Statement of Undisputed Material Facts", {"canonical": "UMF", "party_label": "Plaintiff"}),
    ("Plaintiff's Separate Statement of Undisputed Material Facts in Support of MSJ", {"canonical": "Separate Statement", "party_label": "Plaintiff"}),
    ("DECLARATION OF DANIEL FISHER, ESQ AND PLAINTIFF'S COMPENDIUM OF EXHIBITS IN SUPPORT OF PLAINTIFF'S OPPOSITION TO MOTION SUMMARY JUDGMENT", {"canonical": "Fisher Decl. ISO Opp."}),
    ("NOTICE OF MOTION AND MOTION TO COMPEL FURTHER RESPONSES", {"canonical": "Motion", "target": "Mot. to Compel Further Responses"}),
    ("Notice of Motion for Summary Judgment and Motion for Summary Adjudication", {"canonical": "Motion"}),
    ("Defendant's Notice of Motion and Motion to Strike Answer", {"canonical": "Motion", "target": "Mot. to Strike Answer"}),
    ("Notice of Motion for Sanctions", {"canonical": "Motion"}),
    ("OBJECTIONS TO ANDERSON DECL - MOTION TO VACATE DEFAULT", {"canonical": "Obj. to Anderson Decl."}),
    ("Defendant's Objection to Plaintiff's Request For Judicial Notice", {"canonical": "Obj. to RJN", "party_label": "Defendant"}),
    ("Plaintiff's Objection to Defendant's Evidence", {"canonical": "Obj. to Evidence", "party_label": "Plaintiff"}),
    ("Defendant's Objections to Plaintiff's Motion to Compel Further Responses", {"canonical": "Obj. to Mot.", "party_label": "Defendant"}),
    ("Objection to Declaration of Jane Smith", {"canonical": "Obj. to Smith Decl."}),
    ("Defendant's Objection to Plaintiff's Evidence in Support of Opposition", {"canonical": "Obj. to Evidence"}),
    ("Plaintiff's Evidence in Support of Opposition to Motion for Summary Judgment", {"canonical": "Evidence ISO Opp.", "party_label": "Plaintiff"}),
    ("Defendant's Compendium of Evidence", {"canonical": "Evidence", "party_label": "Defendant"}),
    ("Evidence in Support of Motion to Compel Arbitration", {"canonical": "Evidence ISO Mot."}),
    ("[PROPOSED] ORDER RE PLAINTIFF'S MOTION FOR LEAVE TO AMEND COMPLAINT", {"canonical": "Proposed Order"}),
    ("[PROPOSED] ORDER", {"canonical": "Proposed Order"}),
    ("PROOF OF SERVICE RE NOTICE OF MOTION AND MOTION TO VACATE", {"canonical": "Proof of Service"}),
    ("REQUEST FOR DISMISSAL", {"canonical": "Request for Dismissal"}),
    ("AMENDMENT TO COMPLAINT", {"canonical": "Amendment to Complaint"}),
    ("PLAINTIFF'SOPPOSITION TO DEFENDANT'SMOTION FOR SUMMARY ADJUDICATION", {"canonical": "Opposition"}),
    ("YUDECLARATION IN SUPPORT OF PLAINTIFF'SOPPOSITION TO DEFENDANT'SMSA", {"canonical": "Yu Decl. ISO Opp."}),
    ("25STCV32877 KOSLYNDECLARATION REDEMURRER", {"canonical": "Koslyn Decl."}),
    ("DECLARATION OF PAUL V. CARELLI IV IN SUPPORT OF DEFENDANT'S OPPOSITION", {"canonical": "Carelli Decl. ISO Opp."}),
    ("PLAINTIFF’S EVIDENTIARY OBJECTIONS INSUPPORT OF OPPOSITION TO DEFENDANT’S MOTION FOR SUMMARY JUDGMENT/ADJUDICATION", {"canonical": "Obj. to Evidence", "party_label": "Plaintiff"}),
    ("DEFENDANTS’ OBJECTIONS TO DECLARATION OF CURTIS GARCIA", {"canonical": "Obj. to Garcia Decl.", "party_label": "Defendants"}),
    ("PLAINTIFFS ’ EVIDENTIARY OBJECTIONS TO DECLARATION OF DONNA FORTE FILED IN SUPPORT OF DEFENDANT ’ S MOTION TO COMPEL ENFORCEMENT OF PURPORTED PRE - LITIGATION SETTLEMENT AGREEMENT BETWEEN PLAINTIFFS AND DEFENDANT", {"canonical": "Obj. to Forte Decl."}),
    ("DEFENDANTS’ OBJECTION TO PLAINTIFF’S SEPARATE STATEMENT OF ADDITIONAL UNDISPUTED MATERIAL FACTS", {"canonical": "Obj. to AUMF", "party_label": "Defendants"}),
    ("GENERAL MOTORS, LLC’S RESPONSES TO PLAINTIFF’S EVIDENTIARY OBJECTIONS", {"canonical": "Response to Evid. Objs."}),
    ("DEFENDANT’S RESPONSE TO PLAINTIFF’S OBJECTIONS TO EVIDENCE IN SUPPORT OF MOTION TO COMPEL ARBITRATION", {"canonical": "Response to Evid. Objs.", "party_label": "Defendant"}),
    ("PLAINTIFFS'SEPARATE STATEMENT INOPPOSITION TODEFENDANT AMERICAN HONDA MOTOR CO.,INC.'SMOTION FOR SUMMARY ADJUDICATION", {"canonical": "UMF"}),
    ("GM’S RESPONSE TO PLAINTIFF’S SEPARATE STATEMENT OF DISPUTED MATERIAL FACTS ISO OPPOSITION TO MOTION FOR SUMMARY JUDGMENT OR ADJUDICATION", {"canonical": "Reply Separate Statement"}),
    ("DEFENDANTS’ RESPONSES TO PLAINTIFF’S SEPARATE STATEMENT OF DISPUTED FACTS IN OPPOSITION TO DEFENDANT’S MOTION FOR SUMMARY JUDGMENT OR, IN THE ALTERNATIVE, SUMMARY ADJUDICATION", {"canonical": "Reply Separate Statement", "party_label": "Defendants"}),
    ("PLAINTIFF JOSEPH PALLADINO’S SEPARATE STATEMENT OF DISPUTED FACTS IN OPPOSITION TO DEFENDANT’S MOTION FOR SUMMARY JUDGMENT OR, IN THE ALTERNATIVE, SUMMARY ADJUDICATION", {"canonical": "UMF"}),
    ("DEFENDANTS’ COMPENDIUM OF EVIDENCE ISO MSJ", {"canonical": "Evidence ISO Mot.", "party_label": "Defendants"}),
    ("DEFEND.ANTS'COMPENDIUM OF EVIDENCE lSO MSJ 322943543v.L", {"canonical": "Evidence ISO Mot."}),
    ("PLAINTIFF JOSEPH PALLADINO’S EVIDENCE IN OPPOSITION TO DEFENDANTS’ MOTION FOR SUMMARY JUDGMENT OR ADJUDICATION – PART 1 OF 5", {"canonical": "Evidence ISO Opp.", "party_label": "Plaintiff"}),
    ("PLAINTIFF’S COMPENDIUM OF EXHIBITS IN SUPPORT OF PLAINTIFF’S OPPOSITION TO DEFENDANTS JACK GERLACH, SANTA FE RANCH, LLC, AND LIGHTSOURCE ENTERTAINMENT, LLC’S MOTION FOR SUMMARY JUDGMENT", {"canonical": "Evidence ISO Opp."}),
    ("NOTICE OF ERRATA RE: PLAINTIFF JOSEPH PALLADINO'S EVIDENCE IN OPPOSITION TO DEFENDANTS' MOTION FOR SUMMARY JUDGMENT OR ADJUDICATION- PART 1 OF 2 AND PART 2 OF 2", {"canonical": "Notice of Errata"}),
    ("DEFENDANTS’ ERRATA RE: COMPENDIUM OF EVIDENCE ISO MSJ", {"canonical": "Errata", "party_label": "Defendants"}),
    ("NOTICE OF NON -OPPOSITION TO DEFENDANT GLENDALE ADVENTIST MEDICAL CENTER’S MOTION TO ENFORCE SETTLEMENT PURSUANT TO CALIFORNIA CODE OF CIVIL PROCEDURE 664.6 AND REQUEST TO FILE DOCUMENTS UNDER SEAL", {"canonical": "Notice of Non-Opposition"}),
    ("DEFENDANT GLENDALE ADVENTIST MEDICAL CENTER’S NOTICE OF NO OPPOSITION FILED TO MOTION TO ENFORCE SETTLEMENT", {"canonical": "Notice of Non-Opposition"}),
    ("ANSWER TO COMPLAINT", {"canonical": "Answer"}),
    ("VERIFIED CROSS-COMPLAINT BY HUDSON INSURANCE COMPANY FOR DECLARATORY RELIEF AND INTERPLEADER", {"canonical": "Cross-Complaint"}),
    ("CROSS-COMPLAINANT RESCORE HOLLYWOOD, LLC’S SECOND AMENDED CROSS-COMPLAINT", {"canonical": "SACC"}),
    ("THOMPSONHINELLP ATTORNEYS ATLAW LOSANGELES NOTICE OF RULING AND CONTINUANCE OF CASE MANAGEMENT CONFERENCE", {"canonical": "Notice of Ruling"}),
    ("THOMPSONHINELLP ATTORNEYS ATLAW BERNARDS BUILDERS. INC’S NOTICE AND DEMURRER TO RESCORE HOLLYWOOD, LLC’S LOSANGELES SECOND AMENDED CROSS-COMPLAINT", {"canonical": "Demurrer", "target": "SACC"}),
    ("THOMPSONHINELLP ATTORNEYS ATLAW LOSANGELES BERNARDS BUILDER’S REQUEST FOR JUDICIAL NOTICE IN SUPPORT OF DEMURRER TO SECOND AMENDED CROSS-COMPLAINT OF RESCORE HOLLYWOOD, INC.", {"canonical": "RJN ISO Demurrer", "party_label": "Bernards Builder"}),
    ("DECLARATION OF SHANÉ JACKSON IN SUPPORT OF DEFENDANTS DSV AIR & SEA INC. AND ANTOINE BELOTE’S MOTION TO COMPEL ARBITRATION", {"canonical": "Jackson Decl. ISO Mot."}),
    ("DECLARATION OF DEBORAH R.TOGA", {"canonical": "Toga Decl."}),
    ("DEFENDANTS’ NOTICE OF MOTION AND MOTION FOR SUMMARY JUDGMENT OR, IN THE ALTERNATIVE, SUMMARY ADJUDICATION", {"canonical": "Motion", "target": "Mot. for Summary Judgment"}),
    ("PLAINTIFF’S OPPOSITION TO MSJ/MSA", {"canonical": "Opposition", "target": "Mot."}),
    ("PLAINTIFF'S REQUEST FOR JUDICIALNOTICE OF MORATAYA V. FORTADES (B341752)— PUBLISHED COURT OF APPEAL OPINION REVERSING THIS COURT FOR DUE PROCESS VIOLATIONS", {"canonical": "RJN"}),
    ("PLAINTIFFS V ADIM SARKISYAN AND SERGEY MIRZOYANS' REPLY BRIEF IN SUPPORT OF PLAINTIFFS' MOTION FOR ATTORNEYS' FEES, AND COSTS; DECLARATION OF DAVID N. BARRY, ESQ., WITH EXHIBITS", {"canonical": "Reply"}),
    ("DEFENDANT SERENA MO’S TRIAL BRIEF", {"canonical": "Trial Brief", "party_label": "Defendant"}),
    ("MEMORANDUM OF COSTS (SUMMARY)", {"canonical": "Memorandum of Costs Summary"}),
    ("MEMORANDUM OF COSTS (WORKSHEET)", {"canonical": "Memorandum of Costs Worksheet"}),
    ("NOTICE OF ASSOCIATION OF COUNSEL FOR DEFENDANT AMERICAN HONDA MOTOR CO., INC.", {"canonical": "Notice of Association of Counsel"}),
    ("UNLIMITED JURISDICTION NOTICE OF HEARING ON PETITION FOR APPROVAL FOR TRANSFER OF PAYMENT RIGHTS [ PURSUANT TO CAL . INS. CODE § 10134, ET SEQ.]", {"canonical": "Notice of Hearing"}),
    ("CASE MANAGEMENT STATEMENT", {"canonical": "Case Management Statement"}),
    ("PLAINTIFF’S RESPONSE TO ORDER TO SHOW CAUSE", {"canonical": "Response to Order to Show Cause", "party_label": "Plaintiff"}),
    ("GENERAL ORDER RE MANDATORY ELECTRONIC FILING FOR CIVIL", {"canonical": "General Order re Mandatory Electronic Filing for Civil"}),
    ("MEMORANDUM OF POINTS AND AUTHORITIES", {"canonical": "Memorandum of Points and Authorities"}),
    ("DEFENDANT AMERICAN HONDA MOTOR CO., INC.’S MEMORANDUM OF POINTS AND AUTHORITIES IN SUPPORT OF ITS MOTION FOR SUMMARY ADJUDICATION", {"canonical": "Motion"}),
]

#: What is tested, entries (id and fields), and the name that each must get.
GROUPS = [
    ("two demurrers", [{"id": "a", "canonical": "Demurrer", "target": "SAC"}, {"id": "b", "canonical": "Demurrer", "target": "FAC"}], {"a": "Demurrer to SAC", "b": "Demurrer to FAC"}),
    ("two complaints (one with party)", [{"id": "a", "canonical": "Complaint", "party": None}, {"id": "b", "canonical": "Complaint", "party": "Hopkins"}], {"a": "Complaint", "b": "Hopkins Complaint"}),
    ("two motions", [{"id": "a", "canonical": "Motion", "target": "Mot. to Strike"}, {"id": "b", "canonical": "Motion", "target": "Mot. to Dismiss"}], {"a": "Mot. to Strike", "b": "Mot. to Dismiss"}),
    ("two oppositions", [{"id": "a", "canonical": "Opposition", "target": "Demurrer"}, {"id": "b", "canonical": "Opposition", "target": "Mot."}], {"a": "Opposition to Demurrer", "b": "Opposition to Mot."}),
    ("single opposition stays bare", [{"id": "a", "canonical": "Opposition", "target": "Mot."}], {"a": "Opposition"}),
    ("two replies", [{"id": "a", "canonical": "Reply", "target": "Opp. to Mot."}, {"id": "b", "canonical": "Reply", "target": "Opp. to Demurrer"}], {"a": "Reply to Opp. to Mot.", "b": "Reply to Opp. to Demurrer"}),
    ("level1: opp to different targets", [{"id": "a", "canonical": "Opposition", "target": "Demurrer", "party_label": "Plaintiff"}, {"id": "b", "canonical": "Opposition", "target": "Mot.", "party_label": "Defendant"}], {"a": "Opposition to Demurrer", "b": "Opposition to Mot."}),
    ("level2: two mts different parties", [{"id": "a", "canonical": "Motion", "target": "Mot. to Strike", "party_label": "Plaintiff"}, {"id": "b", "canonical": "Motion", "target": "Mot. to Strike", "party_label": "Defendant"}], {"a": "Plaintiff's Motion", "b": "Defendant's Motion"}),
    ("level2: two demurrers same target different names", [{"id": "a", "canonical": "Demurrer", "target": "SAC", "party_label": "Pacific Insurance"}, {"id": "b", "canonical": "Demurrer", "target": "SAC", "party_label": "Creditco"}], {"a": "Pacific Insurance's Demurrer", "b": "Creditco's Demurrer"}),
    ("level3: complex three-way needing both", [{"id": "a", "canonical": "Opposition", "target": "Ex Parte App.", "party_label": "Receiver"}, {"id": "b", "canonical": "Opposition", "target": "Demurrer", "party_label": "Receiver"}, {"id": "c", "canonical": "Opposition", "target": "Ex Parte App.", "party_label": "Defendant"}], {"a": "Receiver's Opposition to Ex Parte App.", "b": "Receiver's Opposition to Demurrer", "c": "Defendant's Opposition to Ex Parte App."}),
    ("user spec: receiver / plaintiff / blue shield oppositions", [{"id": "a", "canonical": "Opposition", "target": "Ex Parte App.", "party_label": "Receiver"}, {"id": "b", "canonical": "Opposition", "target": "Demurrer", "party_label": "Plaintiff"}, {"id": "c", "canonical": "Opposition", "target": "Ex Parte App.", "party_label": "Pacific Insurance"}], {"a": "Receiver's Opposition", "b": "Plaintiff's Opposition", "c": "Pacific Insurance's Opposition"}),
    ("bare opposition stays bare when sibling has info", [{"id": "a", "canonical": "Opposition", "target": "Demurrer", "party_label": "Plaintiff"}, {"id": "b", "canonical": "Opposition", "target": None, "party_label": None}], {"a": "Opposition to Demurrer", "b": "Opposition"}),
    ("two bare oppositions remain identical", [{"id": "a", "canonical": "Opposition", "target": None, "party_label": None}, {"id": "b", "canonical": "Opposition", "target": None, "party_label": None}], {"a": "Opposition", "b": "Opposition"}),
    ("two defendants one named one not", [{"id": "a", "canonical": "Motion", "target": "Mot. to Strike", "party_label": "Defendant"}, {"id": "b", "canonical": "Motion", "target": "Mot. to Strike", "party_label": "Pacific Insurance"}], {"a": "Defendant's Motion", "b": "Pacific Insurance's Motion"}),
    ("two ex parte apps", [{"id": "a", "canonical": "Ex Parte Application", "target": "Ex Parte App. for Order Shortening Time", "party_label": "Plaintiff"}, {"id": "b", "canonical": "Ex Parte Application", "target": "Ex Parte App. to Seal Records", "party_label": "Defendant"}], {"a": "Ex Parte App. for Order Shortening Time", "b": "Ex Parte App. to Seal Records"}),
    ("two rjns iso opp to different things", [{"id": "a", "canonical": "RJN ISO Opp.", "target": "Opp. to Demurrer", "party_label": "Plaintiff"}, {"id": "b", "canonical": "RJN ISO Opp.", "target": "Opp. to Mot.", "party_label": "Defendant"}], {"a": "RJN ISO Opp to Demurrer", "b": "RJN ISO Opp to Mot."}),
    ("two rjns same target different parties", [{"id": "a", "canonical": "RJN ISO Opp.", "target": "Opp. to Demurrer", "party_label": "Plaintiff"}, {"id": "b", "canonical": "RJN ISO Opp.", "target": "Opp. to Demurrer", "party_label": "Defendant"}], {"a": "Plaintiff's RJN ISO Opp.", "b": "Defendant's RJN ISO Opp."}),
    ("two objections to rjn different parties", [{"id": "a", "canonical": "Obj. to RJN", "target": None, "party_label": "Defendant"}, {"id": "b", "canonical": "Obj. to RJN", "target": None, "party_label": "Plaintiff"}], {"a": "Defendant's Obj. to RJN", "b": "Plaintiff's Obj. to RJN"}),
    ("single objection stays bare", [{"id": "a", "canonical": "Obj. to RJN", "target": None, "party_label": "Defendant"}], {"a": "Obj. to RJN"}),
    ("two evidence iso opp different parties", [{"id": "a", "canonical": "Evidence ISO Opp.", "target": None, "party_label": "Plaintiff"}, {"id": "b", "canonical": "Evidence ISO Opp.", "target": None, "party_label": "Defendant"}], {"a": "Plaintiff's Evidence ISO Opp.", "b": "Defendant's Evidence ISO Opp."}),
    ("two plaintiffs distinguished by name", [{"id": "a", "canonical": "Opposition", "target": "Mot.", "party_label": "Plaintiff", "party_name": "Jordan Avery"}, {"id": "b", "canonical": "Opposition", "target": "Mot.", "party_label": "Plaintiff", "party_name": "Jane Roe"}], {"a": "Jordan Avery's Opposition", "b": "Jane Roe's Opposition"}),
    ("named vs unnamed plaintiff", [{"id": "a", "canonical": "Motion", "target": "Mot. to Strike", "party_label": "Plaintiff", "party_name": "Jordan Avery"}, {"id": "b", "canonical": "Motion", "target": "Mot. to Strike", "party_label": "Plaintiff", "party_name": None}], {"a": "Jordan Avery's Motion", "b": "Plaintiff's Motion"}),
    ("different roles stay role-labeled", [{"id": "a", "canonical": "Motion", "target": "Mot. to Strike", "party_label": "Plaintiff", "party_name": "Jordan Avery"}, {"id": "b", "canonical": "Motion", "target": "Mot. to Strike", "party_label": "Defendant", "party_name": "Pacific Insurance"}], {"a": "Plaintiff's Motion", "b": "Defendant's Motion"}),
    ("two volumes of same evidence appendix", [{"id": "a", "canonical": "Evidence ISO Opp.", "target": None, "party_label": "Plaintiff", "part_vol": "Vol. 1"}, {"id": "b", "canonical": "Evidence ISO Opp.", "target": None, "party_label": "Plaintiff", "part_vol": "Vol. 2"}], {"a": "Evidence ISO Opp. Vol. 1", "b": "Evidence ISO Opp. Vol. 2"}),
    ("single volume keeps its designator", [{"id": "a", "canonical": "Evidence ISO Opp.", "target": None, "party_label": "Plaintiff", "part_vol": "Vol. 1"}], {"a": "Evidence ISO Opp. Vol. 1"}),
    ("two parts of same motion", [{"id": "a", "canonical": "Motion", "target": "Mot. to Compel", "party_label": "Defendant", "part_vol": "Part 1"}, {"id": "b", "canonical": "Motion", "target": "Mot. to Compel", "party_label": "Defendant", "part_vol": "Part 2"}], {"a": "Motion Part 1", "b": "Motion Part 2"}),
    ("same volume different parties", [{"id": "a", "canonical": "Evidence ISO Opp.", "target": None, "party_label": "Plaintiff", "part_vol": "Vol. 1"}, {"id": "b", "canonical": "Evidence ISO Opp.", "target": None, "party_label": "Defendant", "part_vol": "Vol. 1"}], {"a": "Plaintiff's Evidence ISO Opp. Vol. 1", "b": "Defendant's Evidence ISO Opp. Vol. 1"}),
    ("two volumes of same declaration", [{"id": "a", "canonical": "Smith Decl. ISO Mot.", "part_vol": "Vol. 1"}, {"id": "b", "canonical": "Smith Decl. ISO Mot.", "part_vol": "Vol. 2"}], {"a": "Smith Decl. ISO Mot. Vol. 1", "b": "Smith Decl. ISO Mot. Vol. 2"}),
    ("aumf collision uses partyLabel", [{"id": "a", "canonical": "AUMF", "target": None, "party_label": "Plaintiff"}, {"id": "b", "canonical": "AUMF", "target": None, "party_label": "Cross-Plaintiff"}], {"a": "Plaintiff's AUMF", "b": "Cross-Plaintiff's AUMF"}),
]
